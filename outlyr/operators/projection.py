"""Vectors to few dimensions: a seeded random projection, or the leading axes of a bounded warm-up sample."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def matrix(source_dim: int, dim: int, seed: int = 42) -> np.ndarray:
    """Normal entries, each column of length 1."""
    m = np.random.default_rng(seed).standard_normal((source_dim, dim))
    return m / np.linalg.norm(m, axis=0)


def projected(vector: Column, m: np.ndarray) -> Column:
    """vector @ m as Catalyst sums; NULL for a NULL vector."""
    columns = [F.array(*[F.lit(float(x)) for x in m[:, k]]) for k in range(m.shape[1])]
    dot = lambda v, c: F.aggregate(F.zip_with(v, c, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return F.when(vector.isNotNull(), _bound(vector, lambda v: F.array(*[dot(v, c) for c in columns])))


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def hashed_vector(text: Column, dim: int = 64, n: int = 3) -> Column:
    """A text's n-gram counts in hashed buckets, scaled to length 1; zeros for a text shorter than n.

    One pass over the grams sorts their buckets behind one mark for each bucket; a bucket's count is the distance of its mark
    from the next one.
    """
    grams = F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(dim)).cast("double"))
    marks = F.array(*[F.lit(b - 0.5) for b in range(dim + 1)])
    places = lambda both: F.filter(F.transform(both, lambda x, i: F.when(x != F.floor(x), i)), lambda i: i.isNotNull())
    counts = lambda at: F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda b: (F.get(at, b) - F.get(at, b - 1) - 1).cast("double"))
    scaled = lambda c: _bound(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.transform(c, lambda x: x / norm))
    made = _bound(F.sort_array(F.concat(grams, marks)), lambda both: _bound(places(both), lambda at: _bound(counts(at), scaled)))
    return F.when(text.isNotNull(), F.when(F.char_length(text) < n, F.array_repeat(F.lit(0.0), dim)).otherwise(made))


def axes(df: DataFrame, vector: str, order: list[str], warmup: int, dim: int) -> np.ndarray | None:
    """The first right singular vectors of the centred first warmup vectors (a bounded sample); None before there are so many."""
    if warmup < dim:
        raise ValueError(f"warmup {warmup} is below dim {dim}")
    rows = df.filter(F.col(vector).isNotNull()).orderBy(*order).limit(warmup).select(vector).collect()
    if len(rows) < warmup:
        return None
    return leading(np.array([r[0] for r in rows], np.float64), dim)


def leading(x: np.ndarray, dim: int) -> np.ndarray:
    """The first right singular vectors of the centred rows, as columns; their signs are those of their largest entries."""
    found = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:dim]
    return (found * np.sign(found[np.arange(len(found)), np.abs(found).argmax(1)])[:, None]).T


def float_array(column: Column) -> Column:
    return F.transform(column, lambda x: x.cast(DoubleType()))
