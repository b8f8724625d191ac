import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from outlyr.llm import vector_codes


def brute(rows, entries, rounds=4, parts=4):
    """Codes, errors and codebooks by plain whole numbers, one entry after another."""
    rows = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in rows), default=0) // parts)
    cut = []
    for i, v, label in rows:
        whole = [math.floor(1024 * x) for x in v] + [0] * (parts * width - len(v))
        cut.append((i, [tuple(whole[p * width : (p + 1) * width]) for p in range(parts)], label))
    start = sorted(zip(cut, rows), key=lambda r: (r[0][0] is None, r[0][0] or 0, r[1][1]))[:entries]
    books = [[c[1][p] for c, _ in start] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in cut:
                held[best(v[p], books[p])[1]].append(v[p])
            for k, own in held.items():
                books[p][k] = tuple(sum(x) // len(own) for x in zip(*own))
    out, by_label = [], defaultdict(int)
    for i, v, label in cut:
        found = [best(v[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        by_label[label] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted([(i, code, error, by_label[label]) for i, label, code, error in out], key=repr), digest


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    out, books = vector_codes.compressed(df, **options)
    return sorted([(r.id, r.code, r.error, r.label_error) for r in out.collect()], key=repr), vector_codes.digest(books)


def exact(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def test_codes_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)], rng.choice([1, 2, None])) for i in range(150)]
    # A hot vector, exact copies, and components that are whole after scaling, so that distances tie.
    rows += [(200 + i, [0.25] * 12, 7) for i in range(60)] + [(300 + i, [rng.choice([-1, 0, 1]) / 1024 for _ in range(12)], 3) for i in range(60)]
    rows = exact(rows)
    assert found(spark, rows, entries=16) == brute(rows, 16)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = exact([
        (1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [nan, 0.0, 0.0, 0.0], None), (4, [0.0, -inf, 0.0, 0.0], 2), (None, [0.5, 0.5, 0.5, 0.5], None), (5, [0.0, 0.0, 0.0, 0.0], None),
        (5, [0.0, 0.0, 0.0, 0.0], None), (5, [-0.0001, 0.0, 1.0, 0.0], 2), (6, [], 2), (7, [1.0, 2.0, 3.0, 4.0, 5.0], None), (8, [0.0, 0.0], 9),
    ])
    got, digest = found(spark, rows)
    assert (got, digest) == brute(rows, 256) and len(got) == 7
    assert found(spark, [], entries=4) == ([], hashlib.sha256(b"").hexdigest())
    assert found(spark, [(1, None, None)])[0] == []
    assert [r[1:] for r in found(spark, [(1, [], 2), (2, [], 2)])[0]] == [("00000000", 0, 0)] * 2
    huge = found(spark, [(1, [3e38, 0.0, 0.0, 0.0], 1), (2, [-3e38, 0.0, 0.0, 0.0], 1)])[0]
    assert [r[1:] for r in huge] == [("00000000", 0, 0), ("01000000", 0, 0)]


def test_other_columns_may_have_any_names(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 1, 5, "x", "c", 9)], "vec_id long, embedding array<double>, label int, id int, v string, code string, error int")
    assert [tuple(r) for r in vector_codes.compressed(df)[0].collect()] == [(1, 1, "00000000", 0, 0)]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(1, 40), st.integers(0, 26), st.integers(0, 2**32))
def test_screening_loses_no_nearest_entry(width, entries, bits, seed):
    """Close and equal distances at any magnitude, where float32 cannot tell entries apart."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-(1 << bits), (1 << bits) + 1, width)
    book = base + rng.integers(-2, 3, (entries, width))
    x = base + rng.integers(-2, 3, (30, width))
    far = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
    codes, least = vector_codes.nearest(x, book)
    assert [min((d, k) for k, d in enumerate(row)) for row in far.tolist()] == list(zip(least.tolist(), codes.tolist()))


def test_screening_spares_most_entries():
    """The intervals are narrow enough to leave about one entry in plain data."""
    rng = np.random.default_rng(1)
    x, c = (rng.normal(0, 300, (n, 16)).astype(np.int64) for n in (500, 256))
    assert vector_codes.screened(x, c).sum() < 510


@pytest.mark.parametrize("values", [[[1, 2, 3, 4]], [[1, 2, 3, 4]] * 300])
def test_fewer_vectors_than_entries(spark, values):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(values)]
    got, digest = found(spark, rows)
    assert (got, digest) == brute(rows, 256) and {r[1] for r in got} == {"00000000"}
