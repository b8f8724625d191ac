"""Operators whose state follows each key's rows one by one, with bounded memory.

Rows are dealt by key and sorted inside their partition, and a partition is read in Arrow batches: a task holds one batch
and one key's bounded state, never a whole key. States may be given from before and handed on: a key's earlier state stands in
front of its rows, and its last state follows them as a row of its own. by_key_in_blocks() uses this to follow keys of any size:
no task reads more of a key than a stretch of the order.
"""

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from outlyr.session import scratch

#: The column of a state, as bytes.
STATE = "_state"
#: Bytes of a stretch of the order, over all keys, that are followed at once.
BLOCK_BYTES = 512 << 20


def by_key(
    df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str,
    before: DataFrame | None = None, restore: Callable[[bytes], object] | None = None, finish: Callable[[object], bytes] | None = None, tasks: int | None = None,
) -> DataFrame:
    """step(state, rows of one key of one batch) in the rows' order; start() makes a key's first state. tasks: how many keys are dealt to.

    before: the keys and their state, which restore() reads. With finish, the result has a column _state, which is NULL but
    for one row of each key of df, whose other columns are NULL.
    """
    resumes, hands_on = before is not None, finish is not None
    columns = [part.strip().split()[0] for part in re.sub(r"<[^>]*>", "", schema).split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, first = None, None, None

        def last() -> Iterator[pd.DataFrame]:
            if hands_on and state is not None:
                yield pd.DataFrame({c: [first[c] if c in keys else None] for c in columns} | {STATE: [finish(state)]}, dtype=object)

        for batch in batches:
            if not len(batch):
                continue
            # NULL is no text, so it gets a mark of its own.
            marks = [batch[k].isna().map({True: "-", False: "+"}) + batch[k].astype(str) for k in keys]
            same = marks[0].str.cat(marks[1:], sep="\1") if keys else pd.Series("", index=batch.index)
            turn = (same != same.shift()).cumsum()
            for _, rows in batch.groupby(turn, sort=False):
                now = same[rows.index[0]]
                if state is None or now != key:
                    yield from last()
                    key, state, first = now, start(), rows.iloc[0]
                if resumes:
                    given = rows[STATE].notna()
                    if given.any():
                        state = restore(rows.loc[given, STATE].iloc[0])
                    rows = rows[~given].drop(columns=STATE)
                if len(rows):
                    out = step(state, rows)
                    yield out.assign(**{STATE: None}) if hands_on else out
        yield from last()

    if before is not None:
        touched = df.select(*[F.col(k).alias(f"_t_{k}") for k in keys]).distinct()
        mine = before.join(touched, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys], "left_semi") if keys else before
        df = df.withColumn(STATE, F.lit(None).cast("binary")).unionByName(mine.select(*keys, F.col("state").alias(STATE)), allowMissingColumns=True)
        order = [F.col(STATE).isNull(), *order]
    dealt = df.repartition(*([tasks] if tasks else []), *keys).sortWithinPartitions(*keys, *order) if keys else df.repartition(1).sortWithinPartitions(*order)
    return dealt.mapInPandas(run, f"{schema}, {STATE} binary" if finish is not None else schema)


def by_key_in_blocks(
    df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str,
    restore: Callable[[bytes], object], finish: Callable[[object], bytes], size: Column, most: int | None = None,
) -> DataFrame:
    """The rows of by_key(), which follows one stretch of the order after another, each from the states that the last one left.

    The first order column is a number or a time; its quantiles cut the order, so that the rows of a stretch have about most
    bytes, by size. Rows are written once by stretch, and what is said of them once. A table that is one stretch is written nowhere.
    """
    spark, most = df.sparkSession, most or BLOCK_BYTES
    parts = -(-int(df.agg(F.sum(size)).first()[0] or 0) // most)
    cuts = df.agg(F.percentile_approx(order[0], [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    if not cuts:
        return by_key(df, keys, order, start, step, schema)
    # NULL comes first in the order.
    block = sum((F.coalesce(F.col(order[0]) >= F.lit(c), F.lit(False)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    rows = scratch(spark, "blocks")
    df.withColumn("_block", block).write.partitionBy("_block").parquet(rows)
    states, said = None, []
    for b in range(len(set(cuts)) + 1):
        part = spark.read.schema(StructType([*df.schema.fields, StructField("_block", IntegerType())])).parquet(rows).filter(F.col("_block") == b).drop("_block")
        said.append(scratch(spark, "followed"))
        # Small parts must not be put together, as then keys would wait for each other.
        got = by_key(part, keys, order, start, step, schema, states, restore, finish, int(spark.conf.get("spark.sql.shuffle.partitions")))
        got.write.parquet(said[-1])
        found = spark.read.schema(got.schema).parquet(said[-1])
        new = found.filter(F.col(STATE).isNotNull()).select(*keys, F.col(STATE).alias("state"))
        if states is not None:
            old = states.select(*[F.col(k).alias(f"_o_{k}") for k in keys], "state")
            old = old.join(new, [F.col(f"_o_{k}").eqNullSafe(new[k]) for k in keys], "left_anti") if keys else old.limit(0)
            new = new.unionByName(old.select(*[F.col(f"_o_{k}").alias(k) for k in keys], "state"))
        path = scratch(spark, "states")
        new.write.parquet(path)
        states = spark.read.schema(new.schema).parquet(path)
    return spark.read.schema(got.schema).parquet(*said).filter(F.col(STATE).isNull()).drop(STATE)
