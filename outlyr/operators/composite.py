"""Cohorts, composite scores, quality metrics and reports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlyr.functions import labels
from outlyr.operators.encoders import value_ids


def cohort_key(name: str, fields: list[Column]) -> Column:
    """name::value::value; __missing__ for a missing value."""
    return F.concat_ws("::", F.lit(name), *[F.coalesce(f.cast("string"), F.lit("__missing__")) for f in fields])


def by_cohort(events: DataFrame, cohorts: list[tuple[str, list[str], float]]) -> DataFrame:
    """A row for each event and cohort: cohort, cohort_key, weight. An event is extracted once, before this."""
    each = [F.struct(F.lit(n).alias("cohort"), cohort_key(n, [F.col(f) for f in fields]).alias("cohort_key"), F.lit(float(w)).alias("weight")) for n, fields, w in cohorts]
    return events.select("*", F.inline(F.array(*each)))


def composite(scores: DataFrame, event: list[str], digits: int = 2) -> DataFrame:
    """event, composite_score, status: the weighted mean of the scores there are; insufficient_data without one.

    The label is that of the score before it is rounded for show.
    """
    has = F.col("score").isNotNull()
    total = F.sum(F.when(has, F.col("weight") * F.col("score"))) / F.sum(F.when(has, F.col("weight")))
    out = scores.groupBy(*event).agg(total.alias("_s"))
    status = F.when(F.col("_s").isNull(), "insufficient_data").otherwise(labels.label(F.round("_s", 9)))
    return out.select(*event, (F.round("_s", digits) + 0.0).alias("composite_score"), status.alias("status"))


def _judged(status: Column, truth: Column) -> tuple[Column, Column]:
    return F.coalesce(status.isin(*labels.POSITIVE), F.lit(False)), F.coalesce(F.upper(truth).startswith("ANOMALY"), F.lit(False))


def misjudged(scored: DataFrame, status: Column, truth: Column) -> DataFrame:
    """The rows that confusion counts as false, with their kind: FP or FN."""
    said, true = _judged(status, truth)
    return scored.withColumn("kind", F.when(said & ~true, "FP").when(~said & true, "FN")).filter("kind is not null")


def acceptance(responses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """accepted, unaccepted: the numbers of responses."""
    good = F.coalesce(F.col("accepted"), F.lit(False))
    return responses.groupBy(*(by or [])).agg(F.count_if(good).alias("accepted"), F.count_if(~good).alias("unaccepted"))


def confusion(scored: DataFrame, status: Column, truth: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1: positive are the two top labels; truth is a text that starts with ANOMALY."""
    said, true = _judged(status, truth)
    counts = {"tp": said & true, "fp": said & ~true, "tn": ~said & ~true, "fn": ~said & true}
    out = scored.groupBy(*(by or [])).agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def top_contributions(parts: DataFrame, event: list[str], k: int = 5) -> DataFrame:
    """The k largest parts by |delta| of each event and cohort, ties by field."""
    w = Window.partitionBy(*event, "cohort").orderBy(F.abs("delta").desc(), "field")
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def latest_state(versions: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The state row of each key with the highest version: the upsert of an append-only state table."""
    columns = [c for c in versions.columns if c not in keys]
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*columns), version).alias("_s"))
    return last.select(*keys, "_s.*")


def first_seen(df: DataFrame, value: str, order: list[str], block: Column | None = None) -> DataFrame:
    """The distinct values in the order of their first appearance: value, at (from 1). block: see encoders.value_ids."""
    return value_ids(df, value, [], order, block=block).select(value, F.col("id").alias("at"))
