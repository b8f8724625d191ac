"""Fit and score: cohorts, encoders and half-space trees from a configuration, as one Spark plan for each verb."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlyr.functions import labels
from outlyr.operators import composite, encoders, trees, windows


@dataclass(frozen=True)
class Plan:
    """Numeric features of fixed limits, and the cohorts that score them. order ends in a unique column."""

    event: tuple[str, ...]
    order: tuple[str, ...]
    numbers: tuple[tuple[str, float, float], ...]  #: column, limits; a column named in scaled is standardised first
    scaled: tuple[str, ...]
    cohorts: tuple[tuple[str, tuple[str, ...], float], ...]
    window: int = 200
    trees: int = 10
    slices: int = 1
    height: int | None = None

    def forests(self) -> list[trees.Forest]:
        names, limits = [n for n, *_ in self.numbers], [(a, b) for _, a, b in self.numbers]
        return [trees.grow(names, limits, self.trees, self.height or trees.default_height(self.window), k) for k in range(self.slices)]


KEYS = ["cohort", "cohort_key"]


def _cohorts(events: DataFrame, p: Plan) -> DataFrame:
    return composite.by_cohort(events, [(n, list(f), w) for n, f, w in p.cohorts])


def _features(p: Plan) -> Column:
    return F.array(*[F.col(n).cast("double") for n, *_ in p.numbers]).alias("features")


def last_rows(rows: DataFrame, p: Plan) -> DataFrame:
    """The last rows of each key that its reference window can lie in: window + slices' phases, at most 2 * window.

    Spark keeps as many for each task before the shuffle, so a key that holds most rows costs no more than others.
    """
    w = Window.partitionBy(*KEYS).orderBy(*[F.col(c).desc() for c in p.order])
    return rows.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= 2 * p.window)


def fit(train: DataFrame, p: Plan) -> tuple[dict[str, DataFrame], DataFrame]:
    """The scalers' and the trees' states of each cohort key.

    Training vectors take the running statistics of their moment. Only the last 2 * window rows of a key need them: sums
    of what came before those rows, and running sums over them.
    """
    rows = _cohorts(train, p)
    states = {v: encoders.fitted(rows, v, KEYS) for v in p.scaled}
    total = rows.groupBy(*KEYS).agg(F.count("*").alias("_rows"))
    last = last_rows(rows, p)
    since = last.groupBy(*KEYS).agg(F.min(F.struct(*p.order)).alias("_since"))
    for v in p.scaled:
        centre = rows.groupBy(*KEYS).agg(F.percentile_approx(v, 0.5).alias("_c"))
        x = F.col(v) - F.col("_c")
        before = rows.join(since.join(centre, KEYS), KEYS).filter(F.struct(*p.order) < F.col("_since"))
        before = before.groupBy(*KEYS).agg(F.count(v).alias("_n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"), F.min(v).alias("_l"), F.max(v).alias("_h"))
        upto = encoders.running(KEYS, list(p.order))
        own = {"_on": F.count(v).over(upto), "_os": F.sum(x).over(upto), "_oq": F.sum(x * x).over(upto), "_ol": F.min(v).over(upto), "_oh": F.max(v).over(upto)}
        last = last.join(centre, KEYS).join(before, KEYS, "left").withColumns(own)
        both = lambda a, b: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
        n = both("_n", "_on")
        mean = F.try_divide(both("_s", "_os"), n)
        std = F.sqrt(F.greatest(F.try_divide(both("_q", "_oq"), n) - mean * mean, F.lit(0.0)))
        z = encoders.z_score(x, n, mean, std, F.least("_l", "_ol"), F.greatest("_h", "_oh"))
        last = last.withColumn(v, F.round(z, 6)).drop("_c", "_n", "_s", "_q", "_l", "_h", *own)
    # Rows are numbered from the key's start, so that windows fall as if all rows were here.
    last = last.join(total, KEYS).withColumn("at", (F.col("_rows") - F.col("_back") + 1).cast("long")).select(*KEYS, "at", F.col("_rows").alias("trained"), _features(p))
    active = last.withColumn("active", windows.active_slice(F.col("trained"), p.window, p.slices))
    inside = F.floor((F.col("at") - 1 - F.col("active.slice") * (p.window // p.slices)) / p.window) == F.col("active.window")
    rows = active.filter(inside).select(*KEYS, "features", F.col("active.slice").alias("slice"), F.col("active.age").alias("age"))
    forests = p.forests()
    n = len(p.numbers)
    means = rows.groupBy(*KEYS).agg(F.first("slice").alias("slice"), F.first("age").alias("age"), F.array(*[F.coalesce(F.avg(F.get("features", F.lit(i))), F.lit(0.0)) for i in range(n)]).alias("mean"))
    return states, means.join(trees.masses(rows, KEYS, forests, "features", "slice"), KEYS)


def score(events: DataFrame, states: dict[str, DataFrame], model: DataFrame, p: Plan, explain: bool = False) -> DataFrame:
    """A row for each event and cohort: event, cohort, cohort_key, weight, score, label, reference_age (, explanation)."""
    rows = _cohorts(events, p)
    for v in p.scaled:
        rows = encoders.frozen(rows, states[v], v, KEYS, "_z").drop(v).withColumn(v, F.round(F.coalesce("_z", F.lit(0.0)), 6)).drop("_z")
    rows = rows.select(*p.event, *KEYS, "weight", _features(p))
    out = trees.scored(rows, model, KEYS, "features", p.forests(), p.window, explain)
    return out.withColumn("label", labels.label(F.col("score"))).drop("features")


def detect(train: DataFrame, events: DataFrame, p: Plan, digits: int = 2) -> tuple[DataFrame, DataFrame]:
    """Scores by cohort, and composites by event."""
    each = score(events, *fit(train, p), p)
    return each, composite.composite(each, list(p.event), digits)
