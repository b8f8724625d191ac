import numpy as np
import pytest
from pyspark.sql import functions as F

from outlyr.operators import autoencoder, composite, drain, encoders, projection, trees, windows


def series(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"at long, v {kind}")


def column(df, name="x"):
    return [r[name] for r in df.orderBy("at").collect()]


LATENCIES = [100.0, 100.0, 110.0, 90.0, 100.0, 115.0, 85.0, 300.0, 99999999.0]
Z = [0, 0, 1.414214, -1.414214, 0, 1.555428, -1.556624, 2.621521, 2.828427]


def test_standard_scaler(spark):
    df = series(spark, LATENCIES)
    assert column(df.withColumn("x", encoders.standard_scaler(F.col("v"), [], ["at"]))) == pytest.approx(Z, abs=1e-6)
    rows = encoders.blocks(df, "v", [], ["at"], F.expr("at div 2"))
    assert column(rows.withColumn("x", encoders.z_score(F.col("v"), *[F.col(c) for c in ("n", "mean", "std", "low", "high")]))) == pytest.approx(Z, abs=1e-5)


def test_min_max_and_frequency(spark):
    df = series(spark, [100.0, 200.0, 100.0, 150.0, 50.0, 250.0, 100.0, 200.0])
    assert column(df.withColumn("x", encoders.min_max_scaler(F.col("v"), [], ["at"]))) == pytest.approx([0, 1, 0, 0.5, 0, 1, 0.25, 0.75])
    df = series(spark, ["DE", "US", "DE", "DE", "US", "US", "US", "DE"], "string")
    assert column(df.withColumn("x", encoders.frequency_encoder(F.col("v"), "v", [], ["at"]))) == pytest.approx([0, 0, 0.5, 2 / 3, 0.25, 0.4, 0.5, 3 / 7])


def test_indexes(spark):
    df = series(spark, ["b", "a", "b", None, "c"], "string")
    indexed = encoders.label_index(df, "v", [], ["at"], "x")
    assert column(indexed) == [1, 2, 1, None, 3]
    assert column(indexed.withColumn("x", encoders.one_hot(F.col("x"), 2))) == [[1, 0], [0, 1], [1, 0], None, None]
    df = series(spark, ["Chrome", "Firefox", "Edge", "Safari", "Opera"], "string")
    assert column(df.withColumn("x", encoders.hash_index("browser", F.col("v"), 4))) == [2, 3, 0, 1, 2]
    df = series(spark, ["redis", "bob", "10.0.0.1"], "string")
    assert column(df.withColumn("x", encoders.hash_index("message", F.col("v")))) == [101, 1106, 42]
    row = series(spark, ["Chrome"], "string").select(encoders.one_hot_hash("browser", F.col("v"))).first()
    assert row[0] == {"browser__388226": 1.0}


def test_ids_by_blocks_are_those_of_one_window(spark):
    """A key that holds nearly all rows, NULL keys and values, values known before, and values that scored rows alone have."""
    rows = [(i, None if i % 97 == 0 else "big" if i % 10 else f"k{i % 3}", None if i % 13 == 0 else f"v{i * i % 211}", i < 500) for i in range(600)]
    df = spark.createDataFrame(rows, "at long, k string, v string, learns boolean")
    known = spark.createDataFrame([("big", "v4", 1), ("big", "other", 2), (None, "v0", 1)], "k string, v string, id long")
    block = F.expr("at div 7")
    ids = lambda **more: {(r.at, r.x) for r in encoders.label_index(df, "v", ["k"], ["at"], "x", **more).collect()}
    for given in ({}, {"known": known}, {"known": known, "keeps": F.col("learns")}, {"keeps": F.col("learns")}):
        found = ids(**given)
        assert found == ids(**given, block=block) and len(found) == 600
    seen = {}
    want = {(at, None if v is None else seen.setdefault(k, {}).setdefault(v, len(seen[k]) + 1)) for at, k, v, _ in rows}
    assert ids(block=block) == want
    places = lambda *by: {tuple(r) for r in composite.first_seen(df, "v", ["at"], *by).collect()}
    firsts = list(dict.fromkeys(v for _, _, v, _ in rows if v is not None))
    assert places() == places(block) == {(v, i + 1) for i, v in enumerate(firsts)}


def test_blocks_bound_the_largest_task(spark):
    """One key holds all rows; no window of the plan by blocks is dealt by the key alone."""
    df = spark.range(1000).select(F.col("id").alias("at"), F.lit("big").alias("k"), F.col("id").cast("string").alias("v"))
    first = df.groupBy("k", "v").agg(F.min("at").alias("first"), F.min(F.expr("at div 100")).alias("block"))
    plan = encoders.ranked(first, ["k"], "first", "block", "id")._jdf.queryExecution().optimizedPlan().toString()
    ranks = [line for line in plan.splitlines() if "row_number()" in line]
    assert ranks and all("block" in line.split("windowspecdefinition(")[1].split("first")[0] for line in ranks)
    sizes = [r["count"] for r in first.groupBy("k", "block").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_warm_up_waits_for_its_last_row(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0])
    x = column(encoders.warmed_up(df, "v", [], ["at"], 3, "x"))
    s = np.std([1, 2, 3])
    assert x == pytest.approx([-1 / s, 0, 1 / s, 1.5 / np.std([1, 2, 3, 4])])
    assert column(encoders.warmed_up(df, "v", [], ["at"], 5, "x")) == [None] * 4


def test_active_slice(spark):
    ages = lambda ns, w, k: [r[0] and r[0].age for r in spark.createDataFrame([(n,) for n in ns], "n long").select(windows.active_slice(F.col("n"), w, k)).collect()]
    assert ages([5, 10, 14, 15], 10, 2) == [None, 0, 4, 0]
    assert ages([150], 100, 1) == [50] and ages([150], 120, 10) == [6] and ages([55], 50, 5) == [5]


def test_head_tail(spark):
    df = series(spark, [0.0] * 11)
    assert column(windows.head_tail(df, ["at"], 0.2), "is_score") == [False] * 9 + [True] * 2
    assert column(windows.head_tail(df, ["at"], 0.0), "is_score") == [False] * 11
    assert windows.head_tail(df.limit(0), ["at"], 0.2).count() == 0


def forest_rows(spark, values):
    return spark.createDataFrame([("k", i, [v]) for i, v in enumerate(values)], "key string, at long, f array<double>")


def test_written_walks_equal_higher_order_ones(spark, monkeypatch):
    """With slices, absent features and an explanation: both ways of evaluating give the same numbers."""
    forests = [trees.grow(["v", "w"], [(0.0, 1.0), (-1.0, 1.0)], 7, 3, k) for k in range(3)]
    rows = spark.createDataFrame([("ab"[i % 2], i, [0.1 * (i % 10), None if i % 5 == 0 else 0.05 * (i % 20)]) for i in range(150)], "key string, at long, f array<double>")
    model = trees.fit(rows, ["key"], ["at"], "f", forests, 30)
    written = trees.scored(rows, model, ["key"], "f", forests, 30, explain=True).orderBy("at").collect()
    monkeypatch.setattr(trees, "WRITTEN_MOST", 0)
    assert written == trees.scored(rows, model, ["key"], "f", forests, 30, explain=True).orderBy("at").collect()
    assert {r.reference_age for r in written} == {5} and len({r.score for r in written}) > 5


def test_half_space_trees(spark):
    forests = [trees.grow(["v"], [(0.0, 1.0)], 25, 3)]
    train = forest_rows(spark, [0.4 + 0.01 * (i % 5) for i in range(120)])
    model = trees.fit(train, ["key"], ["at"], "f", forests, 100)
    row = model.first()
    assert row.age == 20 and len(row.mass) == 25 and all(len(held) == 16 and held[1] == 100 for held in row.mass)
    events = spark.createDataFrame([("k", 0, [0.41]), ("k", 1, [0.99]), ("new", 2, [0.5])], "key string, at long, f array<double>")
    out = {r.at: r for r in trees.scored(events, model, ["key"], "f", forests, 100, explain=True).collect()}
    assert out[0].score < out[1].score and out[2].score is None and out[2].explanation is None
    # The score is one less an integer over trees * window * (2^(height + 1) - 1).
    for r in (out[0], out[1]):
        s = (1 - r.score / 100) * 25 * 100 * 15
        assert s == pytest.approx(round(s), abs=1e-6)
    assert out[1].explanation.features[0].delta == pytest.approx(out[1].score - out[1].explanation.baseline, abs=1e-3)
    same = forest_rows(spark, [0.5] * 100)
    constant = trees.scored(forest_rows(spark, [0.5]), trees.fit(same, ["key"], ["at"], "f", forests, 100), ["key"], "f", forests, 100).first()
    assert constant.score == 0
    error = events.limit(1).select(trees.limit_error(F.array(F.lit(2.0)), forests[0])).first()[0]
    assert error == "feature 'v' = 2.0 is outside expected range [0.0, 1.0]"


def test_composite(spark):
    df = spark.createDataFrame([(1, 0.25, 80.0), (1, 0.25, None), (1, 0.5, 20.0), (2, 1.0, None)], "e long, weight double, score double")
    assert {tuple(r) for r in composite.composite(df, ["e"]).collect()} == {(1, 40.0, "SLIGHTLY_ELEVATED"), (2, None, "insufficient_data")}
    rows = spark.createDataFrame([("ANOMALOUS", "anomaly:x"), ("NORMAL", "ANOMALY"), ("HIGHLY_ANOMALOUS", "NORMAL"), (None, None)], "s string, t string")
    r = composite.confusion(rows, F.col("s"), F.col("t")).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.precision, r.recall, r.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5)


def test_templates(spark):
    lines = ["Service nginx started on 10.0.0.1", "Service redis started on 10.0.0.2", "User bob logged in", " ", None]
    found = drain.templates(series(spark, lines, "string").withColumn("k", F.lit("x")), ["k"], ["at"], "v", "at").orderBy("at").collect()
    assert [r.template_id for r in found] == [1, 1, 2, None, None]
    assert found[1].template == "Service <*> started on <*>" and found[1].variables == ["redis", "10.0.0.2"]
    miner = drain.Miner(most=2)
    for m in ("a b", "c d", "e f"):
        miner.learn(m)
    assert len(miner.clusters) == 2 and miner.match("a b") is None


def test_projections(spark):
    m = projection.matrix(6, 3)
    assert np.linalg.norm(m, axis=0) == pytest.approx([1, 1, 1])
    v = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    df = spark.createDataFrame([(0, v), (1, None)], "at long, v array<double>")
    got = column(df.withColumn("x", projection.projected(F.col("v"), m)))
    assert got[0] == pytest.approx(np.array(v) @ m) and got[1] is None
    x = np.random.default_rng(0).standard_normal((40, 4)) * [5, 1, 0.1, 0.1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "at long, v array<double>")
    axis = projection.axes(df, "v", ["at"], 40, 1)
    assert abs(axis[0, 0]) > 0.95 and projection.axes(df, "v", ["at"], 41, 1) is None
    got = series(spark, ["abcabc", "ab", None], "string").withColumn("x", projection.hashed_vector(F.col("v"), 16))
    assert [None if r is None else round(sum(a * a for a in r), 6) for r in column(got)] == [1.0, 0.0, None]


def test_autoencoder_finds_unseen_combinations(spark):
    rows = [("k", i, "abc"[i % 3], "xyz"[i % 3], 0.0, True) for i in range(300)] + [("k", 300, "a", "x", 0.0, False), ("k", 301, "a", "y", 4.0, False), ("new", 302, "a", "x", 0.0, False)]
    df = spark.createDataFrame(rows, "key string, at long, c string, d string, n double, learns boolean")
    out = {r.at: r for r in autoencoder.scored(df, ["key"], ["at"], ["c", "d"], ["n"], "learns", "at", autoencoder.Options(warmup=50, every=10, epochs=10, rate=0.01)).collect()}
    assert out[301].score > out[300].score and out[301].score == 100 and out[302].score is None
    assert out[301].buffered == 300 and out[301].events_since_retrain == 0
