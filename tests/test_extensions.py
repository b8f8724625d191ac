"""A foreign encoder and a foreign model, used by Engine and by Service without a change to either."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from outlyr import config, extensions
from outlyr.plans.engine import Engine
from outlyr.plans.service import Service


def largest(rows, value, before):
    """State of each key: the largest absolute value so far."""
    now = rows.filter("phase = 0").groupBy("key").agg(F.max(F.abs(value)).alias("top"))
    if before is not None:
        now = now.join(before.select(F.col("key").alias("_k"), F.col("state")["top"].alias("_old")), F.col("key").eqNullSafe(F.col("_k")), "left")
        now = now.select("key", F.greatest("top", "_old").alias("top"))
    return now.filter("top is not null").select("key", F.create_map(F.lit("top"), F.col("top")).alias("state"))


def share_of_largest(df, column, out, params, before):
    """Each value as a share of the largest up to it."""
    upto = Window.partitionBy("key").orderBy("phase", "seq").rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(F.when(F.col("phase") == 0, F.abs(column))).over(upto)
    if before is not None:
        df = df.join(before.select(F.col("key").alias("_k"), F.col("state")["top"].alias("_old")), F.col("key").eqNullSafe(F.col("_k")), "left").drop("_k")
        top = F.greatest(top, F.col("_old"))
    return df.withColumn(out, params.get("times", 1) * F.col(column) / top).drop("_old"), [out]


def distance(rows, state, params):
    joined = rows.join(state.select(F.col("key").alias("_k"), F.col("state")["top"].alias("_top")), F.col("key").eqNullSafe(F.col("_k")), "left")
    share = 100 * F.abs(F.get("features", F.lit(0))) / (F.col("_top") * params["scale"])
    return joined.withColumn("anomaly_score", F.when(F.col("_top").isNotNull(), F.least(F.lit(100.0), share))).drop("_k", "_top")


@pytest.fixture
def registered():
    extensions.register_encoder("ShareOfLargest", extensions.Encoder(share_of_largest, lambda rows, c, params, before: largest(rows, c, before), (-50.0, 50.0)))
    extensions.register_model("Distance", extensions.Model(lambda rows, params, before: largest(rows, F.get("features", F.lit(0)), before), distance, {"numeric": "ShareOfLargest"}))
    yield
    del extensions.ENCODERS["ShareOfLargest"], extensions.MODELS["Distance"]


def test_foreign_parts_learn_at_once_and_in_parts(spark, tmp_path, registered):
    raw = {"features": {"f": {"v": "numeric"}}, "cohorts": [{"name": "all", "fields": ["k"], "features_config": "f", "model": {"name": "Distance", "params": {"scale": 2}}}]}
    frame = lambda rows, at: spark.createDataFrame([(at + i, json.dumps(r)) for i, r in enumerate(rows)], "seq long, j string").select("seq", F.parse_json("j").alias("payload"))
    ingest, asked = [{"k": i % 2, "v": i % 7 + 1} for i in range(20)], [{"k": 0, "v": 7}, {"k": 1, "v": 3.5}, {"k": 1, "v": 700}, {"k": 5, "v": 1}]
    made = config.parse(raw)
    whole = Engine(made).run(frame(ingest, 0), frame(asked, 20)).orderBy("seq").collect()
    service = Service(spark, made, str(tmp_path / "models"))
    for a, b in ((0, 3), (3, 4), (4, 20)):
        service.learn(frame(ingest[a:b], a))
    parts = service.score(frame(asked, 20)).orderBy("seq").collect()
    assert [r.composite_score for r in whole] == [50.0, 25.0, None, None] and whole[2].error.startswith("feature 'v__0' = 100.0 is outside")
    assert [tuple(r) for r in parts] == [tuple(r) for r in whole]


def test_unknown_names_are_errors():
    with pytest.raises(ValueError, match="Unknown model: 'Distance'"):
        config.parse({"features": {"f": {}}, "cohorts": [{"name": "a", "features_config": "f", "model": "Distance"}]})
