"""Helpers that several operators share."""

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The blanks that part words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, whole and in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session of one machine, as in tests, gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        own = tempfile.mkdtemp(prefix="outlyr-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session sends Python at most so many rows at once, as whole documents are large; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


#: Spark's own removal of a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again, for tables that are read more than once.

    Its lineage ends there and its shuffles' files go at once. The files go with discard(), or when the driver ends.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/outlyr-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.outlyr_path = path
    return out


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Deletes what written() wrote, once nothing will read it again; a lost executor cannot ask for it, as what came of it is stored."""
    for table in tables:
        place, files = _place(table.sparkSession, table.outlyr_path)
        files.delete(place, True)


def slices(batch, column: str | None = None, most: int = 1 << 20):
    """An Arrow batch (or array, without column) in slices of at most so many bytes of a column, or of one larger row; no copies."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column) if column else batch), 0).cast("int64")).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop
