"""Near-duplicates by circulant MinHash: two permutations give all coordinates of a signature.

Shingles are numbers below 2^64. The first permutation deals them anew; coordinate k of a set is the least value of the second
permutation, circularly shifted by k places, over what the first made of the set: min over s of p2(p1(s) - k mod 2^64). Both are
bijections of 64 bits, so the chance that a coordinate of two sets agrees is their Jaccard similarity.

A band is a number of coordinates, and sets that agree in a band are a bucket. With 32 bands of 4, two sets at 80 in 100 miss each
other with a chance of (1 - 0.8^4)^32 = 5e-8; no bucket is capped. All pairs of a bucket are covered without being written down:

1. each set meets the least set that leads one of its buckets;
2. each set meets the leads of those of its buckets that are in other components after that;
3. all pairs of a bucket that are still in different components, and whose sizes allow a link, are tried: those of a small
   bucket as rows, those of a large one in blocks. A task holds two blocks, counts what each two of their sets have in common
   by matrix products, and gives one link for each two components that it joins, so no pairs of a large bucket are written.

What is in one component needs no test. Pairs are confirmed on whole sets of 64-bit hashes, links become components, and a group
of copies, which share a set, is one set. Sets of texts that share no bucket are not gathered.

Nulls and empty texts have empty sets and are linked with nothing. Texts of fewer words than a shingle are one shingle; texts
of any length are read whole. Repeated rows share one set. A null id counts in no component's smallest id, and is kept if its
component has no other. An empty table gives no rows. Ties do not arise: leads are told apart by hashes, components by their
smallest id. Only the two named columns are read.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlyr.llm.common import discard, small_batches, table, written
from outlyr.llm.ngram_join import components, fingerprint, hidden_number, named, set_batches, sets_of, verified
from outlyr.llm.shingles import mixed

BANDS, ROWS = 32, 4
#: Sets of a bucket whose pairs are written as rows; beyond it, blocks of at most so many sets, and shingles, are compared.
PAIRED, BLOCK_SETS, BLOCK_SHINGLES = 32, 2048, 1 << 20
#: Numbers of a matrix of sets by shingles.
CELLS = 1 << 22
# What tells the two permutations and the bands apart.
FIRST, SECOND, BAND = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x3C6EF372FE94F82A), np.uint64(0x9E3779B97F4A7C15)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """The signature of each set that is not empty: coordinates, sets."""
    starts = np.cumsum([0, *map(len, sets)][:-1])
    with np.errstate(over="ignore"):
        dealt = mixed(np.concatenate(sets) ^ FIRST)
        out = np.empty((coordinates, len(sets)), np.uint64)
        for k in range(coordinates):
            np.minimum.reduceat(mixed((dealt - np.uint64(k)) ^ SECOND), starts, out=out[k])
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each set: sets, bands."""
    with np.errstate(over="ignore"):
        parts = signature.reshape(-1, rows, signature.shape[1])
        key = (np.arange(len(parts), dtype=np.uint64) * BAND)[:, None]
        for k in range(rows):
            key = mixed(key ^ parts[:, k]) * BAND
    return np.ascontiguousarray(key.T)


def signed(texts: DataFrame, size: int, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n, fp (the set), f (a number for it), bands (where a task meets a set first), written."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, sets in set_batches(batches, size):
            fps = [fingerprint(s.tobytes()) for s in sets]
            fs = [int.from_bytes(f[:8], "little", signed=True) for f in fps]
            new = []
            for i, f in enumerate(fs):
                if len(sets[i]) and f not in seen:
                    seen.add(f)
                    new.append(i)
            keys = [None] * len(sets)
            if new:
                for i, own in zip(new, bands(signatures([sets[i] for i in new], n_bands * rows), rows).view(np.int64)):
                    keys[i] = own
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(fs, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "fp", "f", "bands"])

    kind = texts.schema["id"].dataType.simpleString()
    return written(texts.select("id", "text").mapInArrow(sign, f"id {kind}, n long, fp binary, f long, bands array<long>"), "signed")


def sizes_allow(n1: Column, n2: Column, percent: int) -> Column:
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def common(values: np.ndarray, rows: np.ndarray, n_left: int, n: int) -> np.ndarray:
    """How many values each row below n_left shares with each of the rows from n_left to n (all with all, where these are none)."""
    held, at, times = np.unique(values, return_inverse=True, return_counts=True)
    # A value of one row alone is shared by none.
    place = np.cumsum(times > 1) - 1
    known = times[at] > 1
    at, rows = place[at[known]], rows[known]
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    left, right = (slice(0, n_left), slice(n_left, n)) if n_left < n else (slice(0, n), slice(0, n))
    out = np.zeros((left.stop, right.stop - right.start))
    width = max(1, CELLS // max(1, n))
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        part = slice(*np.searchsorted(at, (first, first + width)))
        matrix = np.zeros((n, width), np.float32)
        matrix[rows[part], at[part] - first] = 1
        out += matrix[left] @ matrix[right].T
    return out


def blocked(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: a link for each two components that sets of one large bucket join; open_ has bucket, fp, n, c (the component).

    A bucket's sets are dealt into blocks by their hash, and each two of its blocks meet in one group.
    """
    parts = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = open_.groupBy("bucket").agg(F.count("*").alias("m"), parts.alias("parts")).filter(F.col("m") > PAIRED).select(F.col("bucket").alias("key"), "parts")
    rows = open_.join(large, F.col("bucket") == hidden_number("key")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.select("bucket", "fp", "c", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "c", "fp").join(sets, "fp")

    def compared(group: pa.Table) -> pa.Table:
        left, right = {}, {}
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        numbers = zip(group.column("fp").to_pylist(), group.column("own").to_pylist(), group.column("c").to_pylist())
        # A repeated row may have given a set twice.
        for i, (fp, own, c) in enumerate(numbers):
            (left if own == low else right)[fp] = (i, c)
        both = [*left.items(), *right.items()]
        held = group.column("set").combine_chunks()
        own = [held[i].values.to_numpy(zero_copy_only=False) for _, (i, _) in both]
        size, c = np.array([len(x) for x in own]), np.array([c for _, (_, c) in both])
        fps = np.array([fp for fp, _ in both], object)
        n_left = len(left) if low < high else len(both)
        same = common(np.concatenate(own), np.repeat(np.arange(len(own)), size), n_left, len(own))
        shift = n_left if low < high else 0
        i, j = np.nonzero(same * (100 + percent) >= (size[:n_left, None] + size[None, shift:]) * percent)
        j += shift
        keep = c[i] < c[j] if low == high else c[i] != c[j]
        i, j = i[keep], j[keep]
        ends = np.stack((np.minimum(c[i], c[j]), np.maximum(c[i], c[j])), 1)
        one = np.unique(ends, axis=0, return_index=True)[1] if len(ends) else []
        return pa.table({"a": pa.array(fps[i[one]].tolist() if len(ends) else [], pa.binary()), "b": pa.array(fps[j[one]].tolist() if len(ends) else [], pa.binary())})

    return rows.groupBy("bucket", "low", "high").applyInArrow(compared, "a binary, b binary")


def similar(docs: DataFrame, id_col="doc_id", text_col="text", size: int = 5, percent: int = 80, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n_shingles, component_id, kept of each row."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    whole = signed(texts, size, n_bands, rows)
    items = written(whole.filter("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("f").alias("f"), F.min("id").alias("id")), "items")
    entries = whole.filter("bands is not null").select("f", F.explode("bands").alias("bucket"))
    # Several tasks may have met a set; buckets of one set alone are no matter. All that is added up are numbers.
    leads = entries.groupBy("bucket").agg(F.min("f").alias("lead"), F.max("f").alias("last")).filter("lead < last").select(F.col("bucket").alias("key"), "lead")
    met = written(entries.join(leads, F.col("bucket") == hidden_number("key")).select("bucket", "f", "lead"), "met")
    in_bucket = met.select("f").distinct()
    sets = sets_of(texts, items.join(in_bucket, "f", "left_semi"), size)
    labels, tried = None, []

    def paired(pairs: DataFrame) -> DataFrame:
        """Pairs of sets (fp, n and other_fp, other_n) as a < b, if sizes allow a link and they have not been tried."""
        both = pairs.filter(sizes_allow(F.col("n"), F.col("other_n"), percent))
        both = both.select(F.least("fp", "other_fp").alias("a"), F.greatest("fp", "other_fp").alias("b"))
        return both.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti") if tried else both

    def ends(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """Pairs of numbers (f, other) with what is known of both."""
        return pairs.join(of, "f").join(of.select(*(F.col(c).alias("other" if c == "f" else f"other_{c}") for c in of.columns)), "other")

    def joined(pairs: DataFrame, more: DataFrame | None = None) -> None:
        """Confirms pairs and adds their links, and more of them, to the components."""
        nonlocal labels
        pairs = written(pairs, "pairs")
        before = [] if labels is None else [labels]
        tried.append(pairs)
        links = verified(pairs, sets, percent)
        links = written(links if more is None else links.unionByName(more), "links")
        if labels is None or not links.isEmpty():
            known = [x.select(F.col("fp").alias("a"), F.col("label").alias("b")) for x in before]
            labels = components(links.unionByName(*known) if known else links)
            discard(*before)
        discard(links)

    def labelled() -> DataFrame:
        """f, fp, n and a number for the component of each set that is in a bucket."""
        return items.join(labels, "fp", "left").select("f", "fp", "n", F.xxhash64(F.coalesce("label", "fp")).alias("c"))

    # A lead is less than the sets that it leads, so two sets meet in one order only.
    joined(paired(ends(met.groupBy("f").agg(F.min("lead").alias("other")).filter("f <> other"), items.select("f", "fp", "n"))))
    marked = written(labelled(), "marked")
    led = met.filter("f <> lead").select("f", F.col("lead").alias("other")).distinct()
    joined(paired(ends(led, marked).filter("c <> other_c")))
    discard(marked)
    open_ = met.select("bucket", "f").distinct().join(labelled(), "f")
    several = open_.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m")).filter("low < high").select(F.col("bucket").alias("key"), "m")
    open_ = written(open_.join(several, F.col("bucket") == hidden_number("key")).select("bucket", "fp", "n", "c", "m"), "open")
    x, y = (open_.filter(F.col("m") <= PAIRED).alias(t) for t in "xy")
    across = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.c") < F.col("y.c")) & sizes_allow(F.col("x.n"), F.col("y.n"), percent))
    across = across.select("x.fp", "x.n", F.col("y.fp").alias("other_fp"), F.col("y.n").alias("other_n")).distinct()
    joined(paired(across), blocked(open_.drop("m"), sets, percent))
    discard(open_, met, sets, *tried)
    found = named(items, labels)
    discard(items, labels)
    out = whole.select("id", "n", "fp").join(found, "fp", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    found = similar(table(spark, sf_dir, "documents"), size=4, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
