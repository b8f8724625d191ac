"""Filter interaction audit: what each filter removes, repeats and loses in every order in which the filters may be applied.

1. Rows are sorted by text fingerprint (SHA-256), text and doc_id. Ranges are cut on fingerprint and doc_id, so that what reaches
   the driver to find the cuts is short, and a text that a third of all rows hold is cut by doc_id. Each task streams its
   sorted rows and compares each with the one before it: a row repeats a text if a smaller doc_id of the text came before.
2. A run of one text may begin in an earlier task. Each task says which text it begins and ends with; one row a task, in order,
   tells the least doc_id of the run that a task continues, and the first rows of such a task are judged again by it.
3. A row's five failures are a mask. Masks are counted by part, with the labels that the audit watches: at most 128 counters
   a part. Counters of any number of inputs add up, and everything else is worked out from them: no row is visited for an order.

The share of a filter in all orders is exact: a row that fails m filters is removed by each of them in 1 / m of the orders.

Nulls: a null text counts as empty, a null part as the empty string; a null doc_id is smaller than none and repeats nothing.
Empty texts are texts: one fails A, and passes B to D. Texts of any length are read whole. Ties: rows alike in text and doc_id
fail alike. Of several labels of a doc_id any 1 counts. An empty table gives no rows. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlyr.llm.common import WORD, discard, small_batches, table, words, written

FILTERS = "ABCDE"
#: The filter of repeated texts; it needs the other rows, all others the text alone.
REPEATED = "E"
#: Rows that Python gets at once.
BATCH = 1000


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def own_failures(text: Column) -> Column:
    """The mask of what a text fails by itself."""
    w = words(text)
    # Words are split once: the array is bound by a one-element array.
    by_words = F.get(F.transform(F.array(w), lambda x: F.when(F.size(x) < 100, bit("A")).otherwise(0) + F.when(100 * F.size(F.array_distinct(x)) < 80 * F.size(x), bit("B")).otherwise(0)), F.lit(0))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return by_words + F.when(100 * capitals > 10 * F.char_length(text), bit("C")).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), bit("D")).otherwise(0)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts on sorted rows, and one row of bounds at the end.

    doc_id, part, mask, repeats, leads: whether the row may repeat the text that the task before ends with. The bounds have
    no mask: first, last (texts), least (the smallest doc_id of the last run) and whole (whether all rows are one run).
    """
    task = task_number()
    first = last = least = None
    runs = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts, ids = batch.column("text"), batch.column("doc_id")
        same = [texts[0].as_py() == last and runs > 0] + pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_pylist()
        repeats, leads = [], []
        for equal, i in zip(same, ids.to_pylist()):
            if not equal:
                runs, least = runs + 1, None
            # Ids of a text come in order, nulls first.
            least = i if least is None else least
            repeats.append(i is not None and i > least)
            leads.append(runs == 1 and i is not None and not repeats[-1])
        if first is None:
            first = texts[0].as_py()
        last = texts[n - 1].as_py()
        yield _rows(task, ids, batch.column("part"), batch.column("mask"), repeats, leads)
    if runs:
        yield _rows(task, pa.array([least], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), None, None, first, last, runs == 1)


def task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _rows(task: int, ids: pa.Array, part: pa.Array, mask: pa.Array, repeats, leads, first=None, last=None, whole=None) -> pa.RecordBatch:
    n = len(ids)
    flag = lambda x: pa.nulls(n, pa.bool_()) if x is None else pa.array(x, pa.bool_())
    bound = lambda x, kind: pa.array([x] * n, kind)
    return pa.RecordBatch.from_arrays(
        [pa.array([task] * n, pa.int64()), ids, part, mask, flag(repeats), flag(leads), bound(first, pa.string()), bound(last, pa.string()), bound(whole, pa.bool_())],
        ["task", "doc_id", "part", "mask", "repeats", "leads", "first", "last", "whole"],
    )


def continued(bounds: DataFrame) -> DataFrame:
    """task, carried: the least doc_id of the run that a task continues. One row a task; its windows run over tasks alone."""
    order = Window.orderBy("task")
    joins = F.coalesce(F.col("first") == F.lag("last").over(order), F.lit(False))
    found = bounds.select("task", "least", "whole", joins.alias("joins"))
    # A task that is all one run hands on what it was given.
    chain = F.sum(F.when(F.col("joins") & F.col("whole"), 0).otherwise(1)).over(order)
    found = found.withColumn("chain", chain).withColumn("upto", F.min("least").over(Window.partitionBy("chain").orderBy("task")))
    return found.select("task", F.when(F.col("joins"), F.lag("upto").over(order)).alias("carried")).filter("carried is not null")


def swept(docs: DataFrame, id_col="doc_id", text_col="text", part_col="lang") -> DataFrame:
    """The sorted rows' verdicts and the tasks' bounds, written."""
    small_batches(docs.sparkSession, BATCH)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("print"))
    dealt = rows.repartitionByRange("print", "doc_id").sortWithinPartitions("print", "text", "doc_id")
    # Masks are made after the sort, so that the pass that finds the ranges reads fingerprints alone.
    marked = dealt.select("doc_id", "text", "part", own_failures(F.col("text")).cast("int").alias("mask"))
    return written(marked.mapInArrow(_swept, "task long, doc_id long, part string, mask int, repeats boolean, leads boolean, first string, last string, whole boolean"), "swept")


def masks(verdicts: DataFrame) -> DataFrame:
    """doc_id, part, mask of each row, from what swept() wrote."""
    carried = continued(verdicts.filter("mask is null").select("task", F.col("doc_id").alias("least"), "first", "last", "whole"))
    out = verdicts.filter("mask is not null").join(carried, "task", "left")
    again = F.col("repeats") | F.coalesce(F.col("leads") & (F.col("carried") < F.col("doc_id")), F.lit(False))
    return out.select("doc_id", "part", (F.col("mask") + F.when(again, bit(REPEATED)).otherwise(0)).alias("mask"))


def counted(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: additive counters; those of several inputs are added up."""
    any_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.select("doc_id", "quality", "toxic").filter("doc_id is not null").groupBy("doc_id").agg(any_one("quality").alias("good"), any_one("toxic").alias("toxic"))
    rows = masked.join(known, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def report(counters: DataFrame) -> DataFrame:
    """A row for each part, filter_order and step, from the counters."""
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    # A part without a mask has a counter of 0.
    each = counters.select("part", F.explode(F.array(F.struct("mask", "n", "good", "toxic"))).alias("c"), orders.alias("filter_order"))
    each = each.select("part", "c.*", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = lambda letter: F.instr("filter_order", letter)
    own = before = F.lit(0)
    for x in FILTERS:
        own = own + F.when(place(x) == F.col("step"), bit(x)).otherwise(0)
        before = before + F.when(place(x) < F.col("step"), bit(x)).otherwise(0)
    each = each.withColumns({"own": own, "before": before})
    fails = F.col("mask").bitwiseAND(F.col("own")) > 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda when, n="n": F.sum(F.when(when, F.col(n)).otherwise(0)).cast("long")
    share = F.expr(f"n * {factorial(len(FILTERS))} div greatest(1, bit_count(mask))")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"), F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    verdicts = swept(docs, **columns)
    counters = written(counted(masks(verdicts), labels), "counters")
    discard(verdicts)
    return report(counters)


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
     l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
     m AS (SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
                  {{'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text),
                    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)}} AS f
           FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
     c AS (SELECT part, [k FOR k IN ['A', 'B', 'C', 'D', 'E'] IF CASE k WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END] AS failed, good, toxic FROM m),
     g AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM c GROUP BY part, failed),
     x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
     o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
     s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
     r AS (SELECT part, filter_order, step, own, n, good, toxic, list_contains(failed, own) AS fails, list_has_any(failed, before) AS earlier, failed = [own] AS alone FROM g, s),
     z AS (SELECT part, filter_order, step, any_value(own) AS own, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
                  coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
                  coalesce(sum(good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost
           FROM r GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM z"""
