"""Media columns: bytes stored as greyscale PNG in a binary column, read back with checks, and hashed by low frequencies.

encode() filters each scanline by the least sum of absolute differences (none, sub or up), deflates the lines and wraps
them in chunks. decode() walks the chunks, tests each CRC, inflates, and undoes all five filters with numpy. The hash holds
the signs, against their median, of the low-frequency cosine coefficients of the image.

A null text is empty; an empty text is one line of padding; long texts give tall images. Filters, deflation and the hash
work on blocks of lines, so a task holds a few copies of the largest text's bytes and no wider numbers of all of them.
Equal bytes give equal columns; repeated rows give a row each, and an empty table gives none. Stored bytes that are damaged
are an error, not a result. Only the two named columns are read.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlyr.llm.common import slices, small_batches, table

#: Samples of a scanline; payloads are padded to whole lines.
WIDTH = 576
PAD = b"\xff"
#: Lines that are filtered, deflated and hashed at a time.
BLOCK = 512
#: Frequencies kept along each side.
LOW = 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"


class Damaged(ValueError):
    """The stored bytes are no PNG that this module can read whole."""


def payload(data: bytes) -> bytes:
    """data padded to a positive multiple of WIDTH."""
    return data + PAD * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(image: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The lines of a block, each behind the filter with the least sum of absolute differences; above is the line before it."""
    left, up = np.zeros_like(image), np.empty_like(image)
    left[:, 1:], up[0], up[1:] = image[:, :-1], above, image[:-1]
    tries = (image, image - left, image - up)
    pick = np.stack([np.abs(t.view(np.int8).astype(np.int16)).sum(1) for t in tries]).argmin(0)
    lines = np.empty((len(image), WIDTH + 1), np.uint8)
    lines[:, 0] = pick
    for kind, t in enumerate(tries):
        lines[pick == kind, 1:] = t[pick == kind]
    return lines


def encode(data: bytes, level: int = 6) -> bytes:
    """The PNG, 8-bit greyscale, WIDTH wide, of a payload."""
    image, packer, packed = np.frombuffer(data, np.uint8).reshape(-1, WIDTH), zlib.compressobj(level), []
    for at in range(0, len(image), BLOCK):
        above = image[at - 1] if at else np.zeros(WIDTH, np.uint8)
        packed.append(packer.compress(_filtered(image[at : at + BLOCK], above).tobytes()))
    packed.append(packer.flush())
    head = struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"".join(packed)) + _chunk(b"IEND", b"")


def chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and data of each chunk, checksums tested."""
    if media[:8] != SIGNATURE:
        raise Damaged("no PNG signature")
    at = 8
    while at < len(media):
        if at + 12 > len(media):
            raise Damaged("cut short")
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + size]
        if len(data) < size or at + 12 + size > len(media):
            raise Damaged("cut short")
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise Damaged(f"checksum of {kind!r}")
        yield kind, data
        at += 12 + size
        if kind == b"IEND":
            return
    raise Damaged("no end")


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of 8-bit greyscale scanlines, each with its filter in front.

    Runs of plain and up lines are one running sum; sub lines are running sums along the line; average and Paeth
    lines depend on each sample before them and are undone one by one.
    """
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise Damaged("unknown filter")
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(kinds >= 2, prepend=False))
    y = 0
    for y in range(len(out)) if (kinds >= 3).any() else ():
        above = out[y - 1] if y else np.zeros(out.shape[1], np.uint8)
        if kinds[y] == 2:
            out[y] += above
        elif kinds[y] >= 3:
            a = c = 0
            row, up = out[y].tolist(), above.tolist()
            for x, b in enumerate(up):
                if kinds[y] == 3:
                    near = (a + b) >> 1
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    near = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[x] = a = (row[x] + near) & 255
                c = b
            out[y] = row
    if not (kinds >= 3).any():
        for start, stop in zip(edges[::2], [*edges[1::2], len(out)][: len(edges[::2])], strict=True):
            first = max(start - 1, 0)
            out[first:stop] = np.cumsum(out[first:stop], axis=0, dtype=np.uint8)
    return out


def decode(media: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlacing."""
    size, packed = None, []
    for kind, data in chunks(media):
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", data)
            if form != [8, 0, 0, 0, 0]:
                raise Damaged(f"not 8-bit greyscale: {form}")
            size = height, width
        elif kind == b"IDAT":
            packed.append(data)
    if size is None:
        raise Damaged("no header")
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != size[0] * (size[1] + 1):
        raise Damaged("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(size[0], size[1] + 1))


def cosines(n: int, low: int = LOW) -> np.ndarray:
    """[low, n]: the first rows of the cosine transform of n samples."""
    return np.cos(np.pi * np.arange(low)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n)) / n


def frequency_hash(image: np.ndarray) -> bytes:
    """low * low bits: coefficients above the median of all but the mean."""
    across, down = cosines(image.shape[1]).T, cosines(image.shape[0])
    found = sum(down[:, at : at + BLOCK] @ (image[at : at + BLOCK].astype(np.float64) @ across) for at in range(0, len(image), BLOCK))
    found = found.round(6).ravel()
    return np.packbits(found > np.median(found[1:])).tobytes()


def stored(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id_col, n_bytes, media: each text as a PNG in a binary column, made once for each row."""
    small_batches(docs.sparkSession)

    def to_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                data = [(t or "").encode() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([encode(payload(d)) for d in data], pa.binary())], [id_col, "n_bytes", "media"])

    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(to_media, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """media with what its stored bytes hold: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, hash (binary)."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary")
    def look(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for m in batch:
            image = decode(m)
            flat = image.reshape(-1)
            rows.append((flat.size, hashlib.sha256(flat).hexdigest(), zlib.crc32(flat[-32:]), len(m), hashlib.sha256(m).hexdigest(), frequency_hash(image)))
        return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"])

    return media.select("*", look("media").alias("_seen")).select("*", "_seen.*").drop("_seen")


def query(spark, sf_dir: str) -> DataFrame:
    seen = read_back(stored(table(spark, sf_dir, "documents")))
    return seen.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("hash")).alias("feature"))
