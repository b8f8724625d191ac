"""States and scores at rest: an append-only Parquet state table and report sinks."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlyr.operators import encoders
from outlyr.operators.composite import latest_state


class StateTable:
    """Versions of each key's state; the last version of a key is its state. Nothing is pickled and nothing rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, states: DataFrame, version: int) -> None:
        """Adds states (with model_type and model_key) as a version, which holds for its keys from then on."""
        states.withColumns({"version": F.lit(version).cast("long"), "last_updated": F.current_timestamp()}).write.mode("append").parquet(self.path)

    def load(self, model_type: str | None = None) -> DataFrame:
        rows = latest_state(self.spark.read.option("mergeSchema", "true").parquet(self.path), ["model_type", "model_key"], "version")
        if "deleted" in rows.columns:
            rows = rows.filter(F.col("deleted").isNull()).drop("deleted")
        return rows if model_type is None else rows.filter(F.col("model_type") == model_type)

    def delete(self, keys: DataFrame, version: int) -> None:
        """Adds a version in which keys (model_type, model_key) have no state; an earlier version of them is not brought back."""
        self.save(keys.select("model_type", "model_key", F.lit(True).alias("deleted")), version)

    def latest_version(self) -> int:
        """The highest version; -1 for a table that holds none yet."""
        try:
            last = self.spark.read.option("mergeSchema", "true").parquet(self.path).agg(F.max("version")).first()[0]
        except AnalysisException:
            return -1
        return -1 if last is None else last

    def keys(self) -> DataFrame:
        return self.load().select("model_type", "model_key")

    def statistics(self) -> DataFrame:
        return self.load().select("model_type", "model_key", "sample_count", "last_updated")


    def learn_moments(self, model_type: str, rows: DataFrame, key: str, v: str) -> int:
        """Adds v's moments of the rows of each key to its state of this type, and gives the version that holds them.

        Only the keys of rows are read, merged and written; learning in parts leaves what learning at once does.
        """
        version = self.latest_version() + 1
        now = encoders.fitted(rows.select(F.col(key).cast("string").alias("model_key"), v).filter("model_key is not null"), v, ["model_key"])
        if version:
            moments = ["n", "mean", "std", "low", "high"]
            known = self.load(model_type).select("model_key", *moments).join(now.select("model_key"), "model_key", "left_semi")
            now = encoders.merged(known, now, ["model_key"])
        self.save(now.select(F.lit(model_type).alias("model_type"), "*", F.col("n").alias("sample_count")), version)
        return version


def anomalous(scored: DataFrame, status: str = "status") -> DataFrame:
    from outlyr.functions.labels import POSITIVE

    return scored.filter(F.col(status).isin(*POSITIVE))


def dump(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
