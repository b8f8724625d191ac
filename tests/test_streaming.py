import pytest
from pyspark.sql import functions as F

from outlyr.operators import encoders
from outlyr.streaming import detector


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "ab"[i % 2], float(i * i % 7) if i % 5 else None, "xyz"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "at long, key string, v double, c string")
    for k in range(3):
        df.filter(F.col("at").between(20 * k, 20 * k + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = detector.encoded(stream, "key", "at", "v", "c").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    got = {r.at: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = df.select("at", encoders.standard_scaler(F.col("v"), ["key"], ["at"]).alias("z"), encoders.frequency_encoder(F.col("c"), "c", ["key"], ["at"]).alias("share")).collect()
    for r in want:
        assert (got[r.at].z is None) == (r.z is None)
        assert r.z is None or got[r.at].z == pytest.approx(r.z, abs=1e-9)
        assert got[r.at].share == pytest.approx(r.share)


def test_tree_stream_equals_batch(spark, tmp_path):
    from outlyr.operators import trees
    from outlyr.streaming import trees as streamed

    forest = trees.grow(["a", "b"], [(0.0, 1.0), (0.0, 1.0)], 5, 3)
    rows = [(i, "xy"[i % 2], [(i * 7 % 10) / 10, (i * 3 % 5) / 5], i < 90) for i in range(100)]
    df = spark.createDataFrame(rows, "at long, key string, f array<double>, learns boolean")
    for k in range(2):
        df.filter(F.col("at").between(50 * k, 50 * k + 49)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streamed.scored(stream, "key", "at", "f", "learns", "at", forest, 20).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    got = {r.event: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    model = trees.fit(df.filter("learns"), ["key"], ["at"], "f", [forest], 20)
    want = {r.at: r.score for r in trees.scored(df.filter("not learns"), model, ["key"], "f", [forest], 20).collect()}
    assert len(want) == 10 and got == pytest.approx(want)


def test_stream_is_scored_with_a_fitted_model(spark, tmp_path):
    """A model at rest scores a stream by stream-static joins, as it scores a table."""
    from outlyr.plans import detect

    p = detect.Plan(event=("at",), order=("at",), numbers=(("v", -5.0, 5.0),), scaled=("v",), cohorts=(("all", (), 1.0), ("key", ("key",), 2.0)), window=20, trees=5)
    df = spark.createDataFrame([(i, "xy"[i % 2], float(i * 7 % 10)) for i in range(120)], "at long, key string, v double")
    states, model = detect.fit(df.filter("at < 100"), p)
    late = df.filter("at >= 100")
    late.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = detect.score(stream, states, model, p).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    rows = lambda d: sorted((r.at, r.cohort, round(r.score, 9), r.label) for r in d.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(detect.score(late, states, model, p)) != []
