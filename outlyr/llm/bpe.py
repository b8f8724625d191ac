"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank file.

Every token becomes a piece: its bytes mapped to printable characters, scored by its negative rank, so that the best-scored
merge is the merge of the lowest rank. The normaliser is the identity. Texts are split by the pre-token pattern first and
each pre-token is encoded by itself; a pre-token that is a token stays whole. Decoding maps pieces back to bytes.

A null text is encoded as an empty one, which has no tokens; texts of any length are encoded whole. Ranks
are distinct, so merges have no ties. Only the named columns are read; repeated rows give a row each, and an empty table
gives none.
"""

import base64
import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlyr.llm.common import slices, small_batches, table

#: Encoded pre-tokens that a task remembers.
REMEMBERED = 100_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it has one, else the next of those from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank; ranks must have no gaps."""
    ranks = dict(reversed(line.split()) for line in Path(path).read_bytes().splitlines() if line)
    return [base64.b64decode(ranks[b"%d" % i]) for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, b""
    while n > 127:
        n, out = n >> 7, out + bytes([n & 127 | 128])
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protobuf field: varint, 32-bit float or bytes."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of tokens by rank; the unknown piece comes after them, so ids are ranks."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, float(score)) + _field(3, kind))
    pieces = [piece("".join(chars[b] for b in t), -rank, normal) for rank, t in enumerate(tokens)]
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*pieces, piece("<unk>", 0, unknown), _field(2, trainer), _field(3, normaliser)])


class Codec:
    """Encodes texts to ids, packed as little-endian unsigned 32-bit integers, and decodes them."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self._split = regex.compile(pattern).findall
        self._chars = dict(enumerate(byte_characters()))
        self._whole = {t: struct.pack("<I", i) for i, t in enumerate(tokens)}
        self._known: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        new = [p for p in dict.fromkeys(parts) if p not in self._known]
        data = [p.encode() for p in new]
        longer = [i for i, d in enumerate(data) if d not in self._whole]
        found = self._model.encode([data[i].decode("latin-1").translate(self._chars) for i in longer], num_threads=1)
        self._known.update({p: self._whole[d] for p, d in zip(new, data, strict=True) if d in self._whole})
        self._known.update({new[i]: struct.pack(f"<{len(ids)}I", *ids) for i, ids in zip(longer, found, strict=True)})

    def encode(self, text: str) -> bytes:
        parts = self._split(text)
        try:
            return b"".join(map(self._known.__getitem__, parts))
        except KeyError:
            if len(self._known) > REMEMBERED:
                self._known.clear()
            self._learn(parts)
            return b"".join(map(self._known.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(docs: DataFrame, vocabulary: str, pattern: str, text_col="text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, ids, decoded_sha256: each text's token ids in a binary column, and the digest of what they decode to.

    vocabulary: the rank file, read by the driver. A task holds one batch of texts and the ids of a slice of it.
    """
    small_batches(docs.sparkSession)
    tokens = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    names = [f"_{k}" for k in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
                digests = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(ids, pa.binary()), pa.array(digests, pa.string())], [*names, "ids", "decoded_sha256"])

    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)], F.col(f"`{text_col}`").alias("text"))
    made = rows.mapInArrow(run, f"{kinds}, ids binary, decoded_sha256 string")
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "ids", "decoded_sha256")


def decoded(ids: DataFrame, vocabulary: str, ids_col="ids") -> DataFrame:
    """ids with bytes: what its ids stand for."""
    shared = ids.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    @F.pandas_udf("binary")
    def to_bytes(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: b"".join(map(shared.value.__getitem__, np.frombuffer(x, "<u4").tolist())))

    return ids.select("*", to_bytes(ids_col).alias("bytes"))


def digest(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    n = (F.octet_length("ids") / 4).cast("long")
    return encoded(docs, vocabulary, pattern).select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
