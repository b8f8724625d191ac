"""python -m outlyr CONFIG TRAIN SCORE OUT: learns the JSON lines of TRAIN, scores those of SCORE, writes responses as JSON.

TRAIN and SCORE are files of one JSON object a line, or Parquet tables with seq and json columns; --order names a path of the
payload that lines are put in order by (else their place in the input). Where the configuration's database names a path, models
last: TRAIN adds to them, and - in its place learns nothing. With debug.dump_results, OUT holds a folder for each run, by date,
with its inputs and responses.
"""

import argparse
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlyr import config
from outlyr.functions import paths
from outlyr.plans.engine import Engine
from outlyr.plans.service import Service
from outlyr.session import session
from outlyr.sources import sinks, state


def events(spark: SparkSession, path: str, order: str | None) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("seq", F.try_parse_json("json").alias("payload"))
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.try_parse_json("value").alias("payload"))
    if order is None:
        return lines
    # Lines are put in order by time, then by their place in the input; those without a time come first. Their numbers are
    # places in a sorted table, so that no task numbers them all and no two lines share one.
    at = F.unix_micros(F.try_to_timestamp(paths.at(F.col("payload"), order, "string")))
    return lines.withColumn("_at", at).orderBy(F.col("_at").asc_nulls_first(), "seq").select(F.monotonically_increasing_id().alias("seq"), "payload")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="outlyr", description=__doc__)
    for name in ("config", "train", "score", "out"):
        p.add_argument(name)
    p.add_argument("--order")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--anomalous-only", action="store_true")
    a = p.parse_args(argv)
    spark = session()
    made, asked = config.load(a.config), events(spark, a.score, a.order)
    if made.database.get("path"):
        service = Service(spark, made)
        if a.train != "-":
            service.learn(events(spark, a.train, a.order))
        out = service.score(asked, a.explain)
    else:
        out = Engine(made).run(events(spark, a.train, a.order), asked, a.explain)
    out = state.anomalous(out) if a.anomalous_only else out
    if made.dump_results:
        sinks.dump(out, sinks.run_folder(spark, a.out, datetime.date.today().isoformat()), asked)
    else:
        state.dump(out, a.out)


if __name__ == "__main__":
    main()
