"""Models that last: learning in parts leaves what learning at once does."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from outlyr import config
from outlyr.plans.engine import Engine
from outlyr.plans.service import Service
from outlyr.sources import sinks
from outlyr.sources.models import ModelStore


def frame(spark, payloads, start=0):
    rows = spark.createDataFrame([(start + i, json.dumps(p)) for i, p in enumerate(payloads)], "seq long, json string")
    return rows.select("seq", F.parse_json("json").alias("payload"))


def answers(df):
    out = []
    for r in df.orderBy("seq").collect():
        scores = [(s.name, s.key, s.score_label, s.properties, s.anomaly_score, s.explanation and [(f.field, f.value, f.delta) for f in s.explanation.features]) for s in r.scores or ()]
        out.append((r.seq, r.accepted, r.error, r.status, r.composite_score, scores))
    return out


def near(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=0.011) and [s[:4] for s in a[5]] == [s[:4] for s in b[5]]
        for s, t in zip(a[5], b[5]):
            assert s[4] == pytest.approx(t[4], abs=1e-6)
            assert sorted(f[:2] for f in s[5] or ()) == sorted(f[:2] for f in t[5] or ())


def in_parts(spark, path, raw, ingest, score, cuts, explain=False):
    """The answers after learning at once, and after learning in parts, each by a service that knows nothing but the path."""
    made = config.parse(raw)
    whole = answers(Engine(made).run(frame(spark, ingest), frame(spark, score, len(ingest)), explain))
    for a, b in zip([0, *cuts], [*cuts, len(ingest)]):
        Service(spark, made, path).learn(frame(spark, ingest[a:b], a))
    parts = answers(Service(spark, made, path).score(frame(spark, score, len(ingest)), explain))
    return whole, parts


def events(n):
    return [{"latency": 100 + i * i % 17, "country": ["DE", "US", "FR"][i % 3], "device": f"d{i % 11}", "user": {"id": f"u{i % 3}"}} for i in range(n)]


FEATURES = {"f": {"latency": "numeric", "country": "str_categorical", "device": {"type": "str_categorical", "preprocessor": "FrequencyEncoder"}}}


def hst(name="all", fields=(), weight=1.0, warmup=None, features="f", **params):
    cohort = {"name": name, "fields": list(fields), "weight": weight, "features_config": features, "model": {"name": "HalfSpaceTrees", "params": {"window_size": 30, "n_trees": 4, **params}}}
    return cohort | ({} if warmup is None else {"warmup_count": warmup})


@pytest.fixture(scope="module", autouse=True)
def small_jobs(spark):
    """These tests run many small jobs, which few partitions suit, and plans that are not compiled."""
    given = {"spark.sql.shuffle.partitions": "2", "spark.sql.codegen.wholeStage": "false"}
    before = {k: spark.conf.get(k) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("cuts", [(29, 31, 90)])
def test_trees_learn_in_parts(spark, tmp_path, cuts):
    raw = {"features": FEATURES, "identifiers": ["user.id"], "cohorts": [hst(sliding_steps=3), hst("user", ["user.id"], 0.5), {"name": "none", "features_config": "f", "model": "NoOp"}]}
    asked = [{"latency": 108, "country": "US", "device": "d1", "user": {"id": "u1"}}, {"latency": 900, "country": "BR", "device": "new", "user": {"id": "u2"}}, {"latency": 1, "user": {"id": "u9"}}, {"latency": "x"}]
    whole, parts = in_parts(spark, str(tmp_path / "models"), raw, events(130), asked, cuts, explain=True)
    near(parts, whole)
    assert parts[0][5][0][4] is not None and parts[3][2].startswith("latency: expected")
    stats = {(r.cohort, r.key): (r.events, r.trained) for r in ModelStore(spark, str(tmp_path / "models")).statistics().collect()}
    assert stats["all", "all"] == (130, 130) and stats["user", "user::u0"] == (44, 44) and stats["none", "none"] == (130, 130)


def test_rows_wait_until_their_key_has_warmed_up(spark, tmp_path):
    """Two keys warm up in the second step, the third never does, and what waits is learned in its order."""
    raw = {"features": {"f": {"latency": "numeric"}}, "cohorts": [hst("user", ["user.id"], warmup=16, window_size=10, n_trees=2)]}
    rows = [e for i, e in enumerate(events(100)) if e["user"]["id"] != "u2" or i < 20]
    asked = [{"latency": 108, "user": {"id": f"u{k}"}} for k in range(3)]
    whole, parts = in_parts(spark, str(tmp_path / "models"), raw, rows, asked, (30,))
    near(parts, whole)
    assert [p[5][0][4] is None for p in parts] == [False, False, True]
    store = ModelStore(spark, str(tmp_path / "models"))
    assert {r.key for r in store.load("keys", "user").collect()} == {"user::u0", "user::u1"}
    assert store.load("waiting", "user").filter("key = 'user::u2'").count() == sum(e["user"]["id"] == "u2" for e in rows)


def test_templates_and_networks_learn_in_parts(spark, tmp_path):
    """Miners, vocabularies, buffers and networks go on where they stopped, to the last digit."""
    raw = {"features": {"f": {"browser": "str_categorical", "latency": "numeric", "message": "str_text"}}, "cohorts": [{"name": "all", "fields": ["os"], "features_config": "f", "model": {"type": "Autoencoder", "params": {"warmup_count": 25, "retrain_every": 10, "epochs_per_retrain": 3, "buffer_size": 60, "seed": 1}}}]}
    ingest = [{"os": ["Linux", "macOS"][i % 5 == 0], "browser": ["Chrome", "Edge", "Safari"][i % 3], "latency": i % 13, "message": f"login from {i % 9} by {'abc'[i % 3]}"} for i in range(120)]
    asked = [{"os": "Linux", "browser": "Chrome", "latency": 3, "message": "login from 1 by a"}, {"os": "Linux", "browser": "new", "latency": 500, "message": "never seen before"}, {"os": "macOS", "browser": "Edge", "latency": 3}]
    whole, parts = in_parts(spark, str(tmp_path / "models"), raw, ingest, asked, (26, 61), explain=True)
    near(parts, whole)
    assert parts[0][5][0][3]["buffer_size"] == 60 and parts[0][5][0][4] is not None


def test_axes_are_learned_once(spark, tmp_path):
    raw = {"features": {"f": {"m": {"type": "str_text", "preprocessor": {"name": "SentenceTransformerEncoder", "params": {"embed_dim": 2}}}}}, "cohorts": [hst(warmup=12, n_trees=5)]}
    texts = [f"{'alpha beta' if i % 2 else 'gamma delta'} {i % 7}" for i in range(70)]
    whole, parts = in_parts(spark, str(tmp_path / "models"), raw, [{"m": t} for t in texts], [{"m": "alpha beta 1"}, {"m": "unlike all"}], (5, 50))
    near(parts, whole)
    assert parts[0][5][0][4] is not None


def test_what_a_cohort_refuses_does_not_reach_later_ones(spark, tmp_path):
    narrow = {"g": {"country": {"type": "str_categorical", "preprocessor": {"name": "OneHotEncoder", "params": {"n_categories": 2}}}}}
    raw = {"features": FEATURES | narrow, "cohorts": [hst("before"), hst("narrow", features="g"), hst("after")]}
    service = Service(spark, config.parse(raw), str(tmp_path / "models"))
    for a, b in ((0, 30), (30, 90)):
        service.learn(frame(spark, events(90)[a:b], a))
    trained = {r.cohort: (r.events, r.trained) for r in service.store.statistics().collect()}
    assert trained == {"before": (90, 90), "narrow": (90, 60), "after": (60, 60)}


def test_steps_that_did_not_end_are_not_read(spark, tmp_path):
    raw = {"features": FEATURES, "cohorts": [hst()]}
    service = Service(spark, config.parse(raw), str(tmp_path / "models"))
    assert service.store.version() == -1 and service.store.load("moments").count() == 0
    service.learn(frame(spark, events(40)))
    held = service.store.load("moments").collect()
    # A writer that dies before its keys are written.
    service.store.save("moments", service.store.load("moments").withColumn("n", F.lit(-1).cast("long")), 1)
    assert service.store.version() == 0 and service.store.load("moments").collect() == held
    assert service.learn(frame(spark, events(60)[40:], 40)) == 1
    assert [r.n for r in service.store.load("moments").collect()] == [60]
    # Of two writers of one version the second fails.
    with pytest.raises(AnalysisException):
        service.store.save("keys", service.store.load("keys"), 1)


def test_models_are_compacted_and_deleted(spark, tmp_path):
    raw = {"features": FEATURES, "cohorts": [hst("user", ["user.id"], window_size=10)]}
    service = Service(spark, config.parse(raw), str(tmp_path / "models"))
    for a, b in ((0, 40), (40, 90)):
        service.learn(frame(spark, events(90)[a:b], a))
    asked = frame(spark, [{"latency": 108, "country": "US", "device": "d1", "user": {"id": f"u{k}"}} for k in range(3)], 90)
    before = answers(service.score(asked))
    assert service.store.compact() == 2 and service.store._numbers("keys", prefix="version=") == [2]
    near(answers(service.score(asked)), before)
    service.store.delete(spark.createDataFrame([("user", "user::u1")], "cohort string, key string"))
    after = answers(service.score(asked))
    assert [a[5][0][4] is None for a in after] == [False, True, False]
    # A deleted key starts anew, also after another compaction.
    service.store.compact()
    service.learn(frame(spark, [e for e in events(90) if e["user"]["id"] == "u1"], 200))
    assert {(r.key, r.trained) for r in service.store.statistics().collect()} == {("user::u0", 30), ("user::u1", 30), ("user::u2", 30)}


def test_the_configuration_names_the_folder(spark, tmp_path):
    raw = {"features": FEATURES, "cohorts": [hst()], "database": {"type": "sqlite", "path": str(tmp_path / "named")}}
    Service(spark, config.parse(raw)).learn(frame(spark, events(5)))
    assert ModelStore(spark, str(tmp_path / "named")).version() == 0
    with pytest.raises(ValueError, match="names no path"):
        Service(spark, config.parse({"features": FEATURES, "cohorts": [hst()]}))


def test_empty_tables(spark, tmp_path):
    service = Service(spark, config.parse({"features": FEATURES, "cohorts": [hst(), hst("w", ["user.id"], warmup=3)]}), str(tmp_path / "models"))
    service.learn(frame(spark, events(1)).limit(0))
    assert service.score(frame(spark, events(1)).limit(0)).count() == 0
    (row,) = service.score(frame(spark, events(1))).collect()
    assert row.status == "insufficient_data"


def test_a_stream_learns_each_batch_once(spark, tmp_path):
    """Stream equals batch for any split into files, also after a restart and where a batch is delivered again."""
    raw = {"features": FEATURES, "cohorts": [hst(sliding_steps=2), hst("user", ["user.id"], warmup=12, window_size=10)], "debug": {"dump_results": True}}
    made, asked = config.parse(raw), [{"latency": 108, "country": "US", "device": "d1", "user": {"id": f"u{k}"}} for k in range(3)]
    whole = answers(Engine(made).run(frame(spark, events(100)), frame(spark, asked, 100)))
    source, checkpoint, models = (str(tmp_path / n) for n in ("in", "checkpoint", "models"))

    def give(folder, payloads, start):
        spark.createDataFrame([(start + i, json.dumps(p)) for i, p in enumerate(payloads)], "seq long, json string").coalesce(1).write.mode("append").parquet(folder)

    def stream(folder):
        rows = spark.readStream.schema("seq long, json string").option("maxFilesPerTrigger", 1).parquet(folder)
        return rows.select("seq", F.parse_json("json").alias("payload"))

    for a, b in ((0, 20), (20, 21), (21, 100)):
        give(source, events(100)[a:b], a)
        Service(spark, made, models).learn_stream(stream(source), checkpoint).trigger(availableNow=True).start().awaitTermination()
    service = Service(spark, made, models)
    assert service.store.version() == 2 and all(service.store.has_batch("events", n) for n in range(3))
    near(answers(service.score(frame(spark, asked, 100))), whole)
    # A checkpoint that is lost delivers all batches anew.
    service.learn_stream(stream(source), str(tmp_path / "another")).trigger(availableNow=True).start().awaitTermination()
    assert service.store.version() == 2
    give(str(tmp_path / "ask"), asked, 100)
    service.score_stream(stream(str(tmp_path / "ask")), str(tmp_path / "c"), str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    said = spark.read.json(str(tmp_path / "out" / "batch=0" / "output")).orderBy("seq").collect()
    assert [r.status for r in said] == [a[3] for a in whole] and spark.read.json(str(tmp_path / "out" / "batch=0" / "input")).count() == 3


def test_runs_and_results(spark, tmp_path):
    raw = {"features": FEATURES, "cohorts": [hst(), {"name": "none", "features_config": "f", "model": "NoOp"}]}
    scored = Engine(config.parse(raw)).run(frame(spark, events(60)), frame(spark, [{"latency": 900, "country": "US", "device": "x" * 50}, {"latency": "x"}], 60), explain=True)
    rows = sinks.results(scored, k=2).orderBy("cohort", "place").collect()
    assert [(r.cohort, r.place) for r in rows] == [("all", 1), ("all", 2), ("none", None)]
    assert abs(rows[0].delta) >= abs(rows[1].delta) and all(r.value is None or len(r.value) <= 40 for r in rows)
    folders = [sinks.run_folder(spark, str(tmp_path / "runs"), "2026-01-02") for _ in range(2)]
    assert [f.rsplit("/", 2)[1:] for f in folders] == [["2026-01-02", "001"], ["2026-01-02", "002"]]
    sinks.dump(scored, folders[0], frame(spark, events(3)))
    assert spark.read.json(f"{folders[0]}/input").count() == 3 and spark.read.json(f"{folders[0]}/output").count() == 2


@pytest.mark.parametrize("warmup", [0, 10])
def test_events_are_kept_as_they_came_where_a_cohort_warms_up(spark, tmp_path, monkeypatch, warmup):
    kept, seen = Service.kept, {}
    monkeypatch.setattr(Service, "kept", lambda self, df, name: seen.setdefault(name, df) and kept(self, df, name))
    cohort = {"name": "all", "features_config": "f", "warmup_count": warmup}
    Service(spark, config.parse({"features": {"f": {"latency": "numeric"}}, "cohorts": [cohort]}), str(tmp_path)).learn(frame(spark, [{"latency": i} for i in range(20)]))
    assert [r.json is not None for r in seen["extracted"].collect()] == [warmup > 0] * 20
