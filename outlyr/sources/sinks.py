"""What is written of a run: responses with their inputs, by date and run, and a table of what was anomalous and why."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlyr.functions.labels import POSITIVE


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def run_folder(spark: SparkSession, path: str, date: str) -> str:
    """path/date/NNN, the first number of the day that no run has taken; taking it is what makes the folder."""
    number = 1
    while True:
        place, files = _files(spark, f"{path}/{date}/{number:03d}/taken")
        files.mkdirs(place.getParent())
        try:
            files.create(place, False).close()
            return f"{path}/{date}/{number:03d}"
        except Exception as taken:
            if not files.exists(place):
                raise taken
            number += 1


def dump(answers: DataFrame, path: str, inputs: DataFrame | None = None) -> None:
    """Responses as JSON lines in path/output, and what they answer in path/input; what lay there goes."""
    if inputs is not None:
        inputs.select("seq", F.to_json("payload").alias("payload")).write.mode("overwrite").json(f"{path}/input")
    answers.write.mode("overwrite").json(f"{path}/output")


def results(answers: DataFrame, k: int = 5, anomalous_only: bool = False) -> DataFrame:
    """A row for each scored event, cohort and one of its k fields with the largest shares: what a report shows.

    seq, status, composite_score, cohort, key, anomaly_score, score_label, place (from 1), field, value, delta. A cohort that
    explains nothing has one row without a field. Values are cut to 40 characters.
    """
    rows = answers.filter(F.col("status").isin(*POSITIVE)) if anomalous_only else answers.filter("accepted")
    each = rows.select("seq", "status", "composite_score", F.explode("scores").alias("s"))
    told = F.filter("s.explanation.features", lambda f: f["delta"].isNotNull())
    each = each.select("seq", "status", "composite_score", F.col("s.name").alias("cohort"), "s.key", "s.anomaly_score", "s.score_label", F.posexplode_outer(F.slice(told, 1, k)).alias("place", "f"))
    value = F.when(F.char_length("f.value") > 40, F.concat(F.substring("f.value", 1, 39), F.lit("…"))).otherwise(F.col("f.value"))
    return each.select("seq", "status", "composite_score", "cohort", "key", "anomaly_score", "score_label", (F.col("place") + 1).alias("place"), "f.field", value.alias("value"), "f.delta")
