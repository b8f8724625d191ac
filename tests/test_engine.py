import json

import pytest
from pyspark.sql import functions as F

from outlyr import config
from outlyr.plans.engine import Engine


def frame(spark, payloads, start=0):
    rows = spark.createDataFrame([(start + i, json.dumps(p)) for i, p in enumerate(payloads)], "seq long, json string")
    return rows.select("seq", F.parse_json("json").alias("payload"))


def run(spark, raw, ingest, score, **options):
    return Engine(config.parse(raw), **{k: v for k, v in options.items() if k == "block"}).run(frame(spark, ingest), frame(spark, score), explain=options.get("explain", False)).orderBy("seq").collect()


FEATURES = {"f": {"latency": "numeric", "country": "str_categorical"}}


def hst(name="all", fields=(), weight=1.0, **params):
    return {"name": name, "fields": list(fields), "weight": weight, "features_config": "f", "model": {"type": "HalfSpaceTrees", "params": {"window_size": 100, **params}}}


def ordinary(n):
    return [{"latency": 100 + i % 7, "country": ["DE", "US"][i % 2], "user": {"id": f"u{i % 3}"}} for i in range(n)]


@pytest.mark.parametrize("block", [False, True])
def test_a_spike_scores_above_the_ordinary(spark, block):
    options = {"block": F.expr("seq div 20")} if block else {}
    out = run(spark, {"features": FEATURES, "cohorts": [hst()]}, ordinary(150), [{"latency": 103, "country": "DE"}, {"latency": 100_000, "country": "DE"}], explain=True, **options)
    assert [r.accepted for r in out] == [True, True]
    assert out[0].composite_score < out[1].composite_score
    assert out[0].scores[0].properties == {"reference_age": 50} and out[0].scores[0].key == "all"
    delta = [{f.field: f.delta for f in r.scores[0].explanation.features}["latency"] for r in out]
    assert delta[1] > abs(delta[0])


def test_cold_start_and_weights(spark):
    raw = {"features": FEATURES, "identifiers": ["user.id"], "cohorts": [hst("all", weight=0.25), hst("user", ["user.id"], 0.75), {"name": "none", "features_config": "f", "model": "NoOp", "weight": 5}]}
    (row,) = run(spark, raw, ordinary(150), [{"latency": 103, "country": "US", "user": {"id": "u1"}}])
    assert [s.name for s in row.scores] == ["all", "user", "none"] and [s.key for s in row.scores] == ["all", "user::u1", "none"]
    assert row.scores[1].anomaly_score is None and row.scores[1].score_label == "INSUFFICIENT_DATA"
    assert row.composite_score == pytest.approx(row.scores[0].anomaly_score, abs=0.01) and row.identifiers == {"user.id": "u1"}
    (row,) = run(spark, raw, ordinary(5), [{"latency": 1, "country": "US"}])
    assert row.composite_score is None and row.status == "insufficient_data" and row.scores[1].key == "user::__missing__"


def test_explanations(spark):
    """Fields with what was read and made of them; without shares where a model gives none. Absent fields are left out."""
    raw = {"features": FEATURES, "cohorts": [hst(), hst("user", ["user.id"]), {"name": "none", "features_config": "f", "model": "NoOp"}]}
    known, partly = run(spark, raw, ordinary(150), [{"latency": 103, "country": "US", "user": {"id": "u1"}}, {"country": "DE"}], explain=True)
    one, cold, none = [{f.field: f for f in s.explanation.features} for s in known.scores]
    assert known.scores[0].explanation.baseline is not None and known.scores[1].explanation.baseline is None
    assert set(one) == set(cold) == set(none) == {"latency", "country"}
    assert one["latency"].value == "103.0" and one["country"].value == "US" and one["country"].preprocessed["country__2"] == [1.0]
    assert all(f.delta is not None for f in one.values()) and all(f.delta is None and f.preprocessed == {} for f in [*cold.values(), *none.values()])
    assert [[f.field for f in s.explanation.features] for s in partly.scores] == [["country"]] * 3


def test_a_key_that_has_not_warmed_up_scores_nothing(spark):
    raw = {"features": FEATURES, "cohorts": [{**hst(), "warmup_count": 140}, {**hst("user", ["user.id"], window_size=20), "warmup_count": 60}]}
    (row,) = run(spark, raw, ordinary(150), [{"latency": 103, "country": "US", "user": {"id": "u1"}}])
    assert row.scores[0].anomaly_score is not None and row.scores[1].anomaly_score is None


def test_rejections(spark):
    raw = {"features": {**FEATURES, "g": {"flag": "boolean"}}, "cohorts": [hst(), {**hst("second"), "features_config": "g"}]}
    ingest = ordinary(99) + [{"latency": 100, "country": "DE", "flag": 1}]
    engine = Engine(config.parse(raw))
    said = engine.ingested(frame(spark, ingest), include_features=True).orderBy("seq").collect()
    assert said[-1].error == "flag: expected bool, got int" and not said[-1].accepted and said[0].accepted
    assert said[0].cohorts[0].features[0].asDict() == {"field": "latency", "value": "100.0"}
    out = engine.run(frame(spark, ingest), frame(spark, [{"latency": 100, "country": "DE", "flag": True}, {"latency": "x"}])).orderBy("seq").collect()
    # The refused event was learned by the cohort before the one that refused it, which makes its window whole.
    assert out[0].scores[0].anomaly_score is not None and out[0].scores[1].anomaly_score is None
    assert out[1].error == "latency: expected int or float, got str" and out[1].scores is None and out[1].status is None


def test_vocabulary_grows_at_score_time_and_overflows(spark):
    raw = {"features": {"f": {"country": {"type": "str_categorical", "preprocessor": {"type": "OneHotEncoder", "n_categories": 2}}}}, "cohorts": [hst()]}
    out = run(spark, raw, [{"country": "DE"}] * 100, [{"country": "DE"}, {"country": "CH"}, {"country": "RU"}])
    assert [r.accepted for r in out] == [True, True, False] and out[2].error == "For 'country' are only 2 categories available"


@pytest.mark.parametrize("encoder", ["MinMaxScaler", "PassThrough", "NoOp", "StandardScaler"])
def test_numeric_encoders(spark, encoder):
    raw = {"features": {"f": {"latency": {"type": "numeric", "preprocessor": encoder}}}, "cohorts": [hst()]}
    # A pass-through has no limits of its own, so its values must lie between -1 and 1.
    ingest = [{"latency": e["latency"] / 1000} for e in ordinary(120)] if encoder == "PassThrough" else ordinary(120)
    out = run(spark, raw, ingest, [{"latency": ingest[3]["latency"]}, {"latency": 10_000}, {}])
    assert out[0].accepted and out[2].accepted
    if encoder in ("MinMaxScaler", "PassThrough"):
        assert out[1].error.startswith("feature 'latency__0' = ") and out[1].error.endswith("is outside expected range [-1.0, 1.0]")
    elif encoder != "NoOp":
        assert out[1].composite_score >= out[0].composite_score


@pytest.mark.parametrize("encoder", ["FrequencyEncoder", "LabelIndex", "HashIndex", "OneHotHashEncoder", "Drain3Encoder", "SentenceTransformerEncoder"])
def test_text_encoders(spark, encoder):
    raw = {"features": {"f": {"country": {"type": "str_text", "preprocessor": encoder}}}, "cohorts": [hst(n_trees=5)]}
    out = run(spark, raw, [{"country": ["DE x", "US y"][i % 2]} for i in range(120)], [{"country": "DE x"}, {"country": "ZZ unseen"}, {}])
    assert all(r.accepted and 0 <= r.composite_score <= 100 for r in out)


def test_warm_up(spark):
    raw = {"features": FEATURES, "cohorts": [{**hst(), "warmup_count": 20}]}
    out = run(spark, raw, ordinary(150), [{"latency": 103, "country": "DE"}])
    assert out[0].composite_score is not None


def test_autoencoder_from_a_configuration(spark):
    raw = {"features": {"f": {"browser": "str_categorical", "os": "str_categorical", "message": "str_text"}}, "cohorts": [{"name": "all", "features_config": "f", "model": {"type": "Autoencoder", "params": {"warmup_count": 40, "retrain_every": 20, "epochs_per_retrain": 20, "lr": 0.01, "seed": 1}}}]}
    pairs = [("Chrome", "Linux"), ("Safari", "macOS"), ("Edge", "Windows")]
    ingest = [{"browser": pairs[i % 3][0], "os": pairs[i % 3][1], "message": f"login from {i}"} for i in range(240)]
    out = run(spark, raw, ingest, [{"browser": "Chrome", "os": "Linux", "message": "login from 1"}, {"browser": "Chrome", "os": "macOS", "message": "login from 1"}], explain=True)
    told = out[1].scores[0].explanation.features
    assert {f.field for f in told} <= {"browser", "os", "message"} and abs(sum(f.delta for f in told) - out[1].scores[0].anomaly_score) < 0.01
    assert out[1].composite_score > out[0].composite_score and out[0].scores[0].properties == {"buffer_size": 240, "events_since_retrain": 0}


def test_unknown_encoder(spark):
    raw = {"features": {"f": {"latency": {"type": "numeric", "preprocessor": "X"}}}, "cohorts": [hst()]}
    with pytest.raises(ValueError, match="Unknown preprocessor: 'X'"):
        run(spark, raw, ordinary(1), ordinary(1))


def test_payloads_are_taken_apart_once(spark):
    """What follows a run reads extracted values: each reading of a payload costs more than a cohort does."""
    rows = spark.range(40).select(F.col("id").alias("seq"), F.to_variant_object(F.struct(F.col("id").cast("double").alias("v"), F.lit("a").alias("k"))).alias("payload"))
    cohorts = [{"name": "all", "features_config": "f"}, {"name": "k", "features_config": "f", "fields": ["k"]}]
    made = config.parse({"features": {"f": {"v": "numeric"}}, "identifiers": ["k"], "cohorts": cohorts})
    out = Engine(made).run(rows.filter("seq < 30"), rows.filter("seq >= 30"))
    assert "variant" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.seq, r.accepted, r.identifiers["k"], len(r.scores)) for r in out.collect()} == {(i, True, "a", 2) for i in range(30, 40)}
