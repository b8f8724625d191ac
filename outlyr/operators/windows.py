"""Count-based windows: tumbling, staggered and rolling, and what follows from counts alone."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "at") -> DataFrame:
    """df with name: the row's number in its key, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def window_id(at: Column, size: int, offset: int = 0) -> Column:
    """The tumbling window of row at, from 0; below 0 before the offset."""
    return F.floor((at - 1 - offset) / size)


def reference_window(at: Column, size: int, offset: int = 0) -> Column:
    """The last complete window after row at; NULL if there is none."""
    full = F.floor((at - offset) / size) - 1
    return F.when(full >= 0, full)


def slice_offset(k: int, size: int, slices: int) -> int:
    return k * (size // slices)


def active_slice(at: Column, size: int, slices: int = 1) -> Column:
    """STRUCT<slice, window, age>: the ready slice that was renewed last (the first of equals); NULL before slice 0 is ready."""
    ready = []
    for k in range(slices):
        o = slice_offset(k, size, slices)
        ready.append(F.when(at - o >= size, F.struct(F.pmod(at - o, F.lit(size)).cast("long").alias("age"), F.lit(k).cast("long").alias("slice"), reference_window(at, size, o).cast("long").alias("window"))))
    return F.when(at >= size, F.array_min(F.array_compact(F.array(*ready))))


def window_statistics(df: DataFrame, keys: list[str], order: list[str], v: str, size: int) -> DataFrame:
    """keys, window, n, mean, std of each complete tumbling window; mean 0 and std 1 where nothing is present."""
    rows = numbered(df, keys, order).withColumn("window", window_id(F.col("at"), size).cast("long"))
    out = rows.groupBy(*keys, "window").agg(F.count("*").alias("rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    std = F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0))
    return out.filter(F.col("rows") == size).select(*keys, "window", "n", F.coalesce("mean", F.lit(0.0)).alias("mean"), std.alias("std"))


def rolling(keys: list[str], order: list[str], size: int):
    """The last size rows up to this one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - size, Window.currentRow)


def retrains(at: Column, warmup: int, every: int) -> Column:
    """Whether the model is built or trained again at row at."""
    return (at >= warmup) & (F.pmod(at - warmup, F.lit(every)) == 0)


def events_since(at: Column, warmup: int, every: int) -> Column:
    """Rows since the model was trained last; NULL before it was built."""
    return F.when(at >= warmup, F.pmod(at - warmup, F.lit(every)))


def head_tail(df: DataFrame, order: list[str], share: float) -> DataFrame:
    """df with is_score: whether a row is among the last int(n * share) of the order.

    The first order column is a number or a time. Quantiles of it, from one pass, bound the cut; rows below the bound are
    counted, and only the few between the bounds are sorted, so that neither a window nor a sort holds all rows.
    """
    n = df.count()
    head = n - int(n * share)
    if head >= n:
        return df.withColumn("is_score", F.lit(False))
    if head <= 0:
        return df.withColumn("is_score", F.lit(True))
    is_time = df.schema[order[0]].dataType.typeName().startswith("timestamp")
    place = (F.unix_micros(F.col(order[0]).cast("timestamp")) if is_time else F.col(order[0])).cast("double")
    q, slack = head / n, 0.002
    low, high = df.select(F.percentile_approx(place, [max(0.0, q - slack), min(1.0, q + slack)], 10_000)).first()[0]
    below = df.filter(place < low).count()
    near = df.filter(place.between(low, high))
    if not below <= head < below + near.count():
        below, near = 0, df  # the estimate missed, which its accuracy rules out for fewer ties than slack
    cut = near.select(F.struct(*order).alias("cut")).orderBy("cut").offset(head - below).limit(1)
    return df.join(F.broadcast(cut), how="cross").withColumn("is_score", F.struct(*order) >= F.col("cut")).drop("cut")
