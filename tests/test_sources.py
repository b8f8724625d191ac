import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlyr.sources import files, state


def test_arff(spark, tmp_path):
    path = tmp_path / "x.arff"
    path.write_text("% note\n@relation r\n@attribute duration NUMERIC\n@attribute 'kind of' {a,b}\n@data\n1.5,a\n?,b\n\n% more\n3\n4,?\n5,'a,b'\n")
    rows = files.arff(spark, str(path)).orderBy("at").collect()
    assert [(r.duration, r["kind of"]) for r in rows] == [(1.5, "a"), (None, "b"), (4.0, None), (5.0, "a,b")]
    assert files.arff(spark, str(path), limit=1).count() == 1


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "x.npz", X=np.array([[1.0, 2.0], [3.0, 4.0]]), y=np.array([0, 1]))
    assert [tuple(r) for r in files.npz(spark, str(tmp_path / "x.npz")).orderBy("at").collect()] == [(0, 0, 1.0, 2.0), (1, 1, 3.0, 4.0)]
    np.savez(tmp_path / "bad.npz", X=np.zeros((1, 1)), y=np.array([2]))
    with pytest.raises(Exception, match="other values than 0 and 1"):
        files.npz(spark, str(tmp_path / "bad.npz")).collect()


def test_csv_stays_text(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b\n1;x\n")
    assert files.csv(spark, str(tmp_path / "x.csv"), sep=";").dtypes == [("a", "string"), ("b", "string")]


def test_steps(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"ingest": [{"v": 1}, {"v": 2}], "scores": [{"v": 3}]}))
    rows = files.steps(spark, str(tmp_path / "s.json")).select("kind", "seq", F.variant_get("payload", "$.v", "int").alias("v")).orderBy("kind", "seq").collect()
    assert [tuple(r) for r in rows] == [("ingest", 0, 1), ("ingest", 1, 2), ("scores", 0, 3)]


def test_predicates(spark):
    df = spark.createDataFrame([(1, "x"), (5, "y")], "n int, s string")
    assert df.filter(files.predicate(".s == 'x' or not (.n < 5)")).count() == 2 and df.filter(files.predicate(".n != 1")).count() == 1
    for bad in ("__import__('os')", ".n + 1", "reflect('a')"):
        with pytest.raises(ValueError):
            files.predicate(bad)


def test_date_math(spark):
    now = F.lit("2026-03-10 15:30:00").cast("timestamp")
    got = spark.range(1).select(files.date_math("now-4w/d", now), files.date_math("now", now), files.date_math("now-1h", now)).first()
    assert tuple(got) == (datetime.datetime(2026, 2, 10), datetime.datetime(2026, 3, 10, 15, 30), datetime.datetime(2026, 3, 10, 14, 30))


def test_state_table(spark, tmp_path):
    t = state.StateTable(spark, str(tmp_path / "state"))
    for version, n in ((1, 3), (2, 7)):
        t.save(spark.createDataFrame([("hst", "all", n)], "model_type string, model_key string, sample_count long"), version)
    t.save(spark.createDataFrame([("hst", "user::a", 1)], "model_type string, model_key string, sample_count long"), 2)
    assert {(r.model_key, r.sample_count) for r in t.load("hst").collect()} == {("all", 7), ("user::a", 1)} and t.keys().count() == 2


def test_states_are_learned_in_parts_and_deleted(spark, tmp_path):
    t = state.StateTable(spark, str(tmp_path / "s"))
    parts = [[("a", 1.0), ("a", 2.0), ("b", 5.0), (None, 1.0)], [("a", 9.0), ("c", 4.0), ("c", None)], [("b", 5.5)]]
    assert t.latest_version() == -1
    assert [t.learn_moments("scaler", spark.createDataFrame(p, "k string, v double"), "k", "v") for p in parts] == [0, 1, 2]
    found = {r.model_key: (r.n, r.mean, r.std, r.low, r.high) for r in t.load("scaler").collect()}
    for k, v in {"a": [1, 2, 9], "b": [5, 5.5], "c": [4]}.items():
        assert found[k] == pytest.approx((len(v), np.mean(v), np.std(v), min(v), max(v)))
    t.delete(t.keys().filter("model_key = 'a'"), 3)
    assert {r.model_key for r in t.keys().collect()} == {"b", "c"} == {r.model_key for r in t.statistics().collect()}
    t.learn_moments("scaler", spark.createDataFrame([("a", 7.0)], "k string, v double"), "k", "v")
    assert {r.model_key: r.n for r in t.load("scaler").collect()} == {"a": 1, "b": 2, "c": 1}


def test_signins_repeat(spark):
    a, b = (files.signins(spark, 500).orderBy("at").collect() for _ in range(2))
    assert a == b and 5 < sum(r.description != "NORMAL" for r in a) < 60
