"""Encoders: running, order-dependent statistics as window expressions, and stateless hashes.

keys are the columns of a cohort key, order the columns of arrival (ending in a unique one). All encoders of a cohort share
one window, so one exchange and one sort serve them all. For a key that holds a large part of all rows, blocks() gives the
same running statistics from sums of blocks of the order, so that no key meets in one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

CLIP = 5.0


def running(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def z_score(v: Column, n: Column, mean: Column, std: Column, low: Column, high: Column) -> Column:
    """0 for fewer than two values or a constant series (by its bounds, as a merged deviation need not be exactly 0)."""
    return F.when(v.isNull(), None).when((n < 2) | (low == high), F.lit(0.0)).otherwise(clipped((v - mean) / F.when(std > 0, std), -CLIP, CLIP))


def statistics(v: Column, w: WindowSpec | None = None) -> dict[str, Column]:
    """n, mean, std (population), low, high of v over a window, or as aggregates."""
    made = {"n": F.count(v), "mean": F.avg(v), "std": F.stddev_pop(v), "low": F.min(v), "high": F.max(v)}
    return {k: c.over(w) if w is not None else c for k, c in made.items()}


def standard_scaler(v: Column, keys: list[str], order: list[str]) -> Column:
    """(v - mean) / std over rows up to this one, clipped to +-5."""
    return z_score(v, *statistics(v, running(keys, order)).values())


def scaled(v: Column, low: Column, high: Column) -> Column:
    return F.when(v.isNull(), None).when(low.isNull(), F.lit(float("nan"))).when(low == high, F.lit(0.0)).otherwise((v - low) / F.when(high > low, high - low))


def min_max_scaler(v: Column, keys: list[str], order: list[str]) -> Column:
    w = running(keys, order)
    return scaled(v, F.min(v).over(w), F.max(v).over(w))


def frequency_encoder(v: Column, value_col: str, keys: list[str], order: list[str]) -> Column:
    """Share of this value among the values before this row; 0 for an unseen one."""
    seen, all_ = F.count(v).over(earlier([*keys, value_col], order)), F.count(v).over(earlier(keys, order))
    return F.when(v.isNull(), None).when(all_ == 0, F.lit(0.0)).otherwise(seen / F.when(all_ > 0, all_))


def ranked(df: DataFrame, keys: list[str], at: str, block: str | None, name: str) -> DataFrame:
    """df with name: the place of a row in its key by at, from 1; NULL keys are one key.

    block: a column that never falls along at. Then rows are counted by block, and ranked inside their block alone, so a key
    that holds most rows meets in as many tasks as it has blocks.
    """
    if block is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(at)))
    heads = df.groupBy(*keys, block).agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select(*[F.col(k).alias(f"_h_{k}") for k in (*keys, block)], F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = df.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys, block).orderBy(at)))
    both = inside.join(heads, [inside[k].eqNullSafe(heads[f"_h_{k}"]) for k in (*keys, block)], "left")
    return both.select(*[inside[c] for c in df.columns], (F.col("_ahead") + F.col("_inside")).alias(name))


def value_ids(df: DataFrame, value_col: str, keys: list[str], order: list[str], known: DataFrame | None = None, block: Column | None = None) -> DataFrame:
    """keys, value_col, id of each value of df: by first appearance in its key, from 1; after the ids of known, which stay.

    block: a value that never falls along the order, for keys that hold more distinct values than a task should (see ranked).
    """
    at = [F.min(F.struct(*order)).alias("_first")]
    if block is not None:
        df, at = df.withColumn("_block", block), [*at, F.min("_block").alias("_block")]
    by = "_block" if block is not None else None
    first = df.filter(F.col(value_col).isNotNull()).groupBy(*keys, value_col).agg(*at)
    if known is None:
        return ranked(first, keys, "_first", by, "id").select(*keys, value_col, F.col("id").cast("int").alias("id"))
    same = lambda left, names: [left[k].eqNullSafe(F.col(f"_k_{k}")) for k in names]
    old = known.select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, value_col)], F.col("id").alias("_id"))
    last = known.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max("id").alias("_last"))
    found = first.join(old, same(first, [*keys, value_col]), "left").select(first["*"], "_id")
    both = found.join(last, same(found, keys), "left").select(found["*"], "_last")
    new = ranked(both.withColumn("_unknown", F.col("_id").isNull()), [*keys, "_unknown"], "_first", by, "_new")
    return new.select(*keys, value_col, F.coalesce("_id", F.coalesce("_last", F.lit(0)) + F.col("_new")).cast("int").alias("id"))


def label_index(df: DataFrame, value_col: str, keys: list[str], order: list[str], name: str, known: DataFrame | None = None, keeps: Column | None = None, block: Column | None = None) -> DataFrame:
    """df with name: the id of the value by first appearance in its key, from 1; known: ids (keys, value_col, id) given before.

    First appearances are a small aggregate (one row for each key and value) that is ranked and joined back. keeps: the rows
    whose new values get an id that lasts; any other new value takes the next id for its own row alone. block: see value_ids.
    """
    rows = df if keeps is None else df.filter(keeps)
    ids = value_ids(rows, value_col, keys, order, known, block)
    if keeps is not None and known is not None:
        ids = ids.unionByName(known.select(*keys, value_col, F.col("id").cast("int"))).distinct()
    named = ids.select(*[F.col(k).alias(f"_i_{k}") for k in (*keys, value_col)], F.col("id").alias(name))
    out = df.join(named, [df[k].eqNullSafe(named[f"_i_{k}"]) for k in (*keys, value_col)], "left").select(df["*"], named[name])
    if keeps is None:
        return out
    last = ids.groupBy(*[F.col(k).alias(f"_i_{k}") for k in keys]).agg(F.max("id").alias("_last"))
    both = out.join(last, [out[k].eqNullSafe(last[f"_i_{k}"]) for k in keys], "left").select(out["*"], "_last")
    fresh = F.when(F.col(value_col).isNotNull(), F.coalesce("_last", F.lit(0)) + 1)
    return both.withColumn(name, F.coalesce(F.col(name), fresh)).drop("_last")


def frequency_blocks(df: DataFrame, value_col: str, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """df with seen and before: how often the row's value, and any value, came before it in its key.

    For keys that hold more rows than a task should: counts of each block of the order, and of each value in it, are added up
    in the order of the blocks, and rows inside their block. block is a value that never falls along the order.
    """
    rows = df.withColumn("_block", block)
    same = lambda a, b, names: [a[k].eqNullSafe(b[f"_b_{k}"]) for k in names]
    out = rows
    for name, by in (("before", keys), ("seen", [*keys, value_col])):
        n = F.count(value_col)
        heads = rows.groupBy(*by, "_block").agg(n.alias("_n"))
        ahead = F.sum("_n").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
        heads = heads.select(*[F.col(k).alias(f"_b_{k}") for k in (*by, "_block")], F.coalesce(ahead, F.lit(0)).alias("_ahead"))
        inside = out.withColumn("_inside", n.over(earlier([*by, "_block"], order)))
        out = inside.join(heads, same(inside, heads, [*by, "_block"]), "left").select(*out.columns, (F.col("_ahead") + F.col("_inside")).alias(name))
    return out.drop("_block")


def one_hot(index: Column, n: int) -> Column:
    """n zeros but for a one at index; NULL beyond n."""
    return F.when(index <= n, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i == index, F.lit(1.0)).otherwise(F.lit(0.0))))


def one_hot_error(index: Column, key: str, n: int) -> Column:
    return F.when(index > n, F.lit(f"For '{key}' are only {n} categories available"))


def hash_bucket(text: Column, n: int) -> Column:
    """The MD5 of a text, as a little-endian number, modulo n."""
    digest = F.md5(text)
    byte = lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(15), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), lambda r, i: F.pmod(r * 256 + byte(i), F.lit(n).cast("long")))


def hash_index(key: str, v: Column, n: int = 2000, seed: int = 0) -> Column:
    """A bucket for a string value; what is no string is hashed by its key alone."""
    return hash_bucket(F.concat(F.lit(f"{seed}:{key}="), v), n)


def one_hot_hash(key: str, v: Column, n: int = 1_048_576, seed: int = 0) -> Column:
    """A sparse map with a one at key__bucket."""
    return F.create_map(F.concat(F.lit(f"{key}__"), hash_index(key, v, n, seed).cast("string")), F.lit(1.0))


def pass_through(v: Column) -> Column:
    return v.cast("double")


def no_op(v: Column) -> Column:
    return F.lit(0.0)


def warmed_up(df: DataFrame, v: str, keys: list[str], order: list[str], warmup: int, name: str) -> DataFrame:
    """df with name: z-scores whose first warmup rows wait for the statistics after row warmup; NULL if it never comes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    stats = {f"_{k}": c for k, c in statistics(F.col(v), running(keys, order)).items()}
    out = df.withColumns({"_at": F.row_number().over(w)} | stats)
    then = lambda c: F.max(F.when(F.col("_at") == warmup, F.col(c))).over(Window.partitionBy(*keys))
    held = {f"{c}w": then(c) for c in stats}
    out = out.withColumns(held)
    pick = [F.when(F.col("_at") <= warmup, F.col(f"{c}w")).otherwise(F.col(c)) for c in stats]
    enough = F.max("_at").over(Window.partitionBy(*keys)) >= warmup
    return out.withColumn(name, F.when(enough, z_score(F.col(v), *pick))).drop("_at", *stats, *held)


def fitted(df: DataFrame, v: str, keys: list[str]) -> DataFrame:
    """The scaler's state of each key after the last row: n, mean, std, low, high."""
    made = [c.alias(k) for k, c in statistics(F.col(v)).items()]
    return df.groupBy(*keys).agg(*made)


MOMENTS = ("n", "mean", "std", "low", "high")


def together(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """The moments of two sets of values at once, from those of each; NULL where neither has a value."""
    na, nb = F.coalesce(a["n"], F.lit(0)), F.coalesce(b["n"], F.lit(0))
    n = na + nb
    part = lambda s, c: F.coalesce(s[c], F.lit(0.0))
    mean = part(a, "mean") + (part(b, "mean") - part(a, "mean")) * F.coalesce(F.try_divide(nb, n), F.lit(0.0))
    apart = F.when((na > 0) & (nb > 0), part(a, "mean") - part(b, "mean")).otherwise(0.0)
    squares = na * part(a, "std") * part(a, "std") + nb * part(b, "std") * part(b, "std") + F.coalesce(F.try_divide(na * nb, n), F.lit(0.0)) * apart * apart
    some = lambda c: F.when(n > 0, c)
    return {"n": n, "mean": some(mean), "std": some(F.sqrt(F.try_divide(squares, n))), "low": F.least(a["low"], b["low"]), "high": F.greatest(a["high"], b["high"])}


def merged(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The state after the rows of two fitted states, as if they had been learned at once: means and squares about them."""
    both = a.select(*keys, F.struct(*MOMENTS).alias("a")).join(b.select(*keys, F.struct(*MOMENTS).alias("b")), keys, "full")
    made = together(*({c: F.col(f"{s}.{c}") for c in MOMENTS} for s in "ab"))
    return both.select(*keys, *[c.alias(k) for k, c in made.items()])


def frozen(df: DataFrame, state: DataFrame, v: str, keys: list[str], name: str) -> DataFrame:
    """df scored with a state that does not learn; NULL for a key without one."""
    joined = df.join(state, keys, "left") if keys else df.join(F.broadcast(state), how="left")
    return joined.withColumn(name, F.when(F.col("n").isNull(), None).otherwise(z_score(F.col(v), *[F.col(c) for c in ("n", "mean", "std", "low", "high")]))).drop("n", "mean", "std", "low", "high")


def blocks(df: DataFrame, v: str, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """df with n, mean, std, low, high of rows up to this one, for keys that hold more rows than a task should.

    block is a value that never falls along the order, such as a day. Sums of each block are added up in the order of
    the blocks, and rows inside their block; the rows of a key meet in as many tasks as it has blocks. Squares are taken
    about the key's median, so that close values keep their digits, far from 0 or beside an extreme one.
    """
    null_safe = lambda a, b, names: [a[k].eqNullSafe(b[k]) for k in names]
    centre = df.groupBy(*keys).agg(F.percentile_approx(v, 0.5).alias("_centre"))
    rows = df.join(centre, null_safe(df, centre, keys), "left").select(df["*"], "_centre") if keys else df.crossJoin(F.broadcast(centre))
    x = F.col(v) - F.col("_centre")
    rows = rows.withColumns({"_block": block, "_x": x, "_xx": x * x})
    sums = [F.count("_x").alias("bn"), F.sum("_x").alias("bs"), F.sum("_xx").alias("bq"), F.min(v).alias("bl"), F.max(v).alias("bh")]
    heads = rows.groupBy(*keys, "_block").agg(*sums)
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    how = {"bn": F.sum, "bs": F.sum, "bq": F.sum, "bl": F.min, "bh": F.max}
    heads = heads.select(*keys, "_block", *[f(c).over(ahead).alias(f"p{c}") for c, f in how.items()])
    inside = running([*keys, "_block"], order)
    own = {"in": F.count("_x").over(inside), "is": F.sum("_x").over(inside), "iq": F.sum("_xx").over(inside), "il": F.min(v).over(inside), "ih": F.max(v).over(inside)}
    rows = rows.withColumns({f"_{k}": c for k, c in own.items()})
    both = rows.join(heads, null_safe(rows, heads, [*keys, "_block"]), "left").select(rows["*"], *[heads[f"p{c}"] for c in how])
    total = lambda a, b: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
    n, s, q = total("pbn", "_in"), total("pbs", "_is"), total("pbq", "_iq")
    mean = F.try_divide(s, n)
    variance = F.greatest(F.try_divide(q, n) - mean * mean, F.lit(0.0))
    out = {"n": n, "mean": mean + F.col("_centre"), "std": F.sqrt(variance), "low": F.least("pbl", "_il"), "high": F.greatest("pbh", "_ih")}
    return both.select(*df.columns, *[c.alias(k) for k, c in out.items()])
