import numpy as np
import pytest
from test_ngram_join import brute, corpus

from outlyr.llm import minhash


def rows_of(found):
    return {(r.id, r.n_shingles, r.component_id) for r in found.collect()}


@pytest.mark.parametrize(("size", "percent", "seed"), [(4, 80, 1), (5, 80, 2)])
def test_components_equal_brute_force(spark, size, percent, seed):
    rows = corpus(250, seed)
    found = minhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=size, percent=percent).cache()
    assert rows_of(found) == brute(rows, size, percent)
    assert all(r.kept == (r.id == r.component_id) for r in found.collect())


def test_large_groups_of_near_copies_with_a_common_passage(spark):
    """Three groups whose members differ by a word or two, and texts that share a passage without being alike."""
    rows = [(g * 1000 + i, " ".join([f"g{g}w{k}" for k in range(80)][: 80 - i % 3] + [f"own{i % 40}"])) for g in range(3) for i in range(120)]
    rows += [(5000 + i, " ".join([f"p{k}" for k in range(30)] + [f"d{i}w{k}" for k in range(25 + i % 30)])) for i in range(60)]
    found = minhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), size=4)
    assert rows_of(found) == brute(rows, 4, 80)


@pytest.mark.parametrize(("paired", "block"), [(0, 2048), (0, 16), (2, 50)])
def test_large_buckets_are_compared_in_blocks(spark, monkeypatch, paired, block):
    """Texts close to one another, below the threshold but for some pairs, in buckets of one block, of many, and in rows."""
    monkeypatch.setattr(minhash, "PAIRED", paired)
    monkeypatch.setattr(minhash, "BLOCK_SETS", block)
    monkeypatch.setattr(minhash, "CELLS", 1 << 12)
    rng = np.random.default_rng(4)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.choice(90, rng.integers(1, 4), replace=False):
            w[k] = f"own{rng.integers(40)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:5])]
    found = minhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=4, percent=85)
    want = brute(rows, 4, 85)
    assert rows_of(found) == want and 1 < len({c for *_, c in want}) < 150


def test_common_counts(spark):
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(12)]
    values, rows = np.concatenate(sets), np.repeat(np.arange(12), [len(s) for s in sets])
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (minhash.common(values, rows, 12, 12) - np.diag(np.diag(minhash.common(values, rows, 12, 12))) == want - np.diag(np.diag(want))).all()
    assert (minhash.common(values, rows, 5, 12) == want[:5, 5:]).all()


def test_a_chain_of_near_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i:] + [f"t{k}" for k in range(i)])) for i in range(40)]
    assert {r.component_id for r in minhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_exact_threshold(spark):
    a, b, c = (" ".join([*map(str, range(19)), *more]) for more in ([], ["x", "y", "z", "u"], ["x", "y", "z", "u", "v"]))
    found = {r.id: r.component_id for r in minhash.similar(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), size=4).collect()}
    assert found == {1: 1, 2: 1}  # 16 in common of 20
    found = {r.id: r.component_id for r in minhash.similar(spark.createDataFrame([(1, a), (3, c)], "doc_id long, text string"), size=4).collect()}
    assert found == {1: 1, 3: 3}


def test_edges(edge, empty):
    found = [(r.id, r.n_shingles, r.component_id, r.kept) for r in minhash.similar(edge, size=4).collect()]
    want = [(1, 6, 1, True), (1, 6, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 59997, 4, True), (None, 1, None, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 7, True)]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert minhash.similar(empty).count() == 0


def test_a_null_id_is_no_smallest_id(spark):
    rows = [(9, "a b c d e"), (None, "a b c d e"), (None, "v w x y z")]
    found = {(r.id, r.component_id, r.kept) for r in minhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert found == {(9, 9, True), (None, 9, False), (None, None, True)}


def test_coordinates_are_shifts_of_one_permutation():
    """A set moved by one place in the first permutation's order has the signature moved by one coordinate."""
    rng = np.random.default_rng(3)
    dealt = rng.integers(0, 1 << 63, 50, dtype=np.uint64)

    def least(k, moved):
        return minhash.mixed((dealt + np.uint64(moved) - np.uint64(k)) ^ minhash.SECOND).min()

    with np.errstate(over="ignore"):
        assert [least(k + 1, 1) for k in range(9)] == [least(k, 0) for k in range(9)]


def test_agreeing_coordinates_estimate_the_similarity():
    rng = np.random.default_rng(7)
    for same in (20, 50, 80):
        a = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        b = np.concatenate((a[:same], rng.integers(0, 1 << 63, 100 - same, dtype=np.uint64)))
        signs = minhash.signatures([np.sort(a), np.sort(b)], 4096)
        assert abs((signs[:, 0] == signs[:, 1]).mean() - same / (200 - same)) < 0.04


def test_misses_are_as_rare_as_the_bands_promise():
    """Pairs at 80 in 100 and a little more: none is missed, and those at 30 in 100 seldom meet."""
    rng = np.random.default_rng(11)

    def met(same, n, of):
        common = rng.integers(0, 1 << 63, (n, same), dtype=np.uint64)
        own = rng.integers(0, 1 << 63, (2, n, of - same), dtype=np.uint64)
        keys = [minhash.bands(minhash.signatures([np.concatenate((c, o)) for c, o in zip(common, own[k])], 128), 4) for k in range(2)]
        return (keys[0] == keys[1]).any(1)

    assert met(8, 2000, 9).all()
    assert met(6, 1000, 13).mean() < 0.35
