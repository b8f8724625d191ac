"""Mixing sources to target weights by a low-discrepancy source schedule.

Sources in code-point order (null last) get weights in turn and share a multiple of all words; a target stops at
max_repeats times its source's words, and what is above goes to the other sources by weight. Slot i of the schedule is the
i-th golden-ratio point, mapped through the sources' cumulative shares, so every stretch of slots holds the sources near
their shares. The r-th slot of a source takes the r-th equal block of words of its shuffled documents, which repeat until
the target is reached; blocks that the schedule leaves short of a target take the slots that others have no block for, and
then those after its end. What comes out is in the order
of the slots: each row says where the mix first takes it and in how many pieces, and mixed documents are dealt by stretches
of slots and stand in their order.

Nulls: a null text has no words and is never taken; null is a source of its own. Ties: documents are shuffled by the MD5 of
their id, then by size and id, so repeated rows are interchangeable. Texts of any length are counted whole, and one that is
longer than a block is taken in several. An empty table gives an empty mix. Only the three named columns are read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlyr.llm.common import WORD, table, words, written

#: Steps of the golden-ratio sequence on a circle of 2^31 points; the step is odd, so every point comes once a round.
CIRCLE = 1 << 31
STEP = 1327217885
#: Documents of a source are ordered inside as many buckets of their shuffle key (16 to the power of its first digits).
BUCKET_DIGITS = 3
#: Slots of a source are ranked inside stretches of so many slots; mixed documents are dealt by stretches of so many.
STRETCH, DEALT = 1024, 16


def sizes(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = 17) -> DataFrame:
    """id, source, size and the shuffle key of each row."""
    i = F.col(f"`{id_col}`")
    size = F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(i.alias("id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(i.cast("string"), F.lit("null")))).alias("shuffle"))


def targets(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """A row for each source: source, no, source_size, weight, target.

    Water-filling in one pass: in the order of cap over weight, the capped sources come first, and the level is
    what is left for the first source that stays under its cap. Its windows run over the sources alone.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * max_repeats
    order = Window.orderBy((cap / F.col("weight")).asc(), "no")
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy()
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumns({"_level": (F.sum("source_size").over(whole) * share - before) / rest, "_at": F.row_number().over(order)})
    under = F.col("_level") * F.col("weight") < cap
    per = per.withColumn("_level", F.min_by("_level", F.when(under, F.col("_at"))).over(whole))
    target = F.coalesce(F.least(cap.cast("double"), F.col("_level") * F.col("weight")), cap.cast("double"))
    return per.select("source", "no", "source_size", "weight", target.alias("target"))


def placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row with its source's columns and start: the words before it in its source's shuffled order.

    Two levels, so that no source meets in one task: words before a bucket of shuffle keys, and before a row in its bucket.
    """
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("bucket", F.substring("shuffle", 1, BUCKET_DIGITS))
    heads = rows.groupBy("no", "bucket").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select("no", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("no", "bucket").orderBy("shuffle", "size", "id")
    rows = rows.withColumns({"row": F.row_number().over(inside), "inside": F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return rows.join(heads, ["no", "bucket"]).withColumn("start", F.col("ahead") + F.col("inside")).drop("ahead", "inside", "shuffle")


def goal() -> Column:
    """The whole words of a source's target."""
    return F.floor("target").cast("long")


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """slot, no, block: which block of which source each slot takes. Slots run from 0 without gaps, one for each block.

    Shares are whole numbers of the circle's points, from whole words, so that they are the same wherever they are worked out.
    """
    spark = sources.sparkSession
    total, n = sources.agg(F.coalesce(F.sum(goal()), F.lit(0)), F.count("*")).first()
    n_slots = -(-total // block_words)
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (F.col("id") % CIRCLE * STEP % CIRCLE).alias("point"))
    upto = lambda frame: F.coalesce(F.sum(goal()).over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, frame)), F.lit(0)).cast("decimal(25,0)")
    shares = sources.withColumns({"_to": upto(0), "_from": upto(-1)})
    edge = lambda c: F.expr(f"cast({c} * cast({CIRCLE} as decimal(10,0)) div cast({max(1, total)} as decimal(20,0)) as long)")
    shares = shares.select("no", edge("_from").alias("low"), edge("_to").alias("high"), F.ceil(goal() / block_words).cast("long").alias("need"))
    # A point's share is found by an equal join on cells of the circle, and by its bounds inside a cell.
    cell = CIRCLE >> max(1, (4 * n).bit_length())
    cells = shares.filter("high > low").select("*", F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"(high - 1) div {cell}"))).alias("cell"))
    drawn = slots.withColumn("cell", F.expr(f"point div {cell}")).join(cells, "cell").filter("point >= low and point < high").select("slot", "no", "need", F.expr(f"slot div {STRETCH}").alias("stretch"))
    heads = drawn.groupBy("no", "stretch").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("no").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select("no", "stretch", "n", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("no", "stretch").orderBy("slot")) - 1
    ranked = drawn.withColumn("inside", inside).join(heads.drop("n"), ["no", "stretch"])
    ranked = ranked.select("slot", "no", (F.col("ahead") + F.col("inside")).alias("block"), "need")
    given = heads.groupBy("no").agg(F.sum("n").alias("given"))
    short = shares.join(given, "no", "left").withColumn("given", F.coalesce("given", F.lit(0))).filter("given < need")
    closing = short.select("no", F.explode(F.sequence("given", F.col("need") - 1)).alias("block"))
    # Slots that a source has no block for are given to such blocks, and then those after the last. Both are few: a source's
    # count of points is off its share by the logarithm of all.
    gaps = ranked.filter("block >= need").select("slot", F.row_number().over(Window.orderBy("slot")).alias("turn"))
    n_gaps = gaps.agg(F.count("*").alias("gaps"))
    closing = closing.withColumn("turn", F.row_number().over(Window.orderBy("block", "no"))).join(gaps, "turn", "left").join(F.broadcast(n_gaps))
    closing = closing.select(F.coalesce("slot", n_slots + F.col("turn") - 1 - F.col("gaps")).cast("long").alias("slot"), "no", "block")
    return ranked.filter("block < need").drop("need").unionByName(closing)


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2), share=1.5, max_repeats=2, block_words: int = 4096, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The rows with their places, and the mix: slot, no, bucket, row, repeat, first, n (words first to first + n of the row)."""
    sized = written(sizes(docs, id_col, text_col, source_col, seed), "sizes")
    sources = written(targets(sized, weights, share, max_repeats).coalesce(1), "sources")
    rows = placed(sized, sources)
    pieces = rows.filter("size > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    pieces = pieces.withColumn("from", F.col("repeat") * F.col("source_size") + F.col("start")).withColumn("to", F.least(F.col("from") + F.col("size"), goal())).filter("`from` < `to`")
    pieces = pieces.withColumn("block", F.explode(F.sequence(F.expr(f"`from` div {block_words}"), F.expr(f"(`to` - 1) div {block_words}"))))
    taken = pieces.join(schedule(sources, block_words), ["no", "block"])
    first = F.greatest("from", F.col("block") * block_words)
    mixed = taken.select("slot", "no", "bucket", "row", "repeat", (first - F.col("from")).alias("first"), (F.least("to", (F.col("block") + 1) * block_words) - first).alias("n"))
    return rows, mixed


def taken_words(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """id, source, size, source_size, target, taken, first_slot, pieces of each row; a sum over the rows and their pieces, without a join.

    first_slot: where the mix first takes the row, null where it never does; pieces: the slots' parts of it.
    """
    key = ["no", "bucket", "row"]
    own = ["id", "source", "size", "source_size", "target"]
    both = rows.select(*key, *own, F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("slot"))
    both = both.unionByName(mixed.select(*key, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in own], "n", "slot"))
    # Only the row itself has a size, so max finds what it holds.
    kept = [F.max(c).alias(c) for c in own]
    return both.groupBy(*key).agg(*kept, F.sum("n").alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("pieces")).drop(*key)


def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """docs as the mix takes them: a row for each time that it is taken, whole or cut to the words that are taken.

    Partitions hold whole stretches of slots, and rows stand in the order of the slots that they begin in, so any stretch
    of rows holds the sources near their shares. A cut text is its first words, joined by single blanks; n_chars follows it
    where docs has that column. Rows alike in id, source and size are interchangeable and take each other's places.
    """
    rows, mixed = mix(docs, id_col, text_col, source_col, **options)
    alike = Window.partitionBy("id", "source", "size")
    took = mixed.groupBy("no", "bucket", "row", "repeat").agg(F.sum("n").alias("_taken"), F.min("slot").alias("_slot"))
    took = rows.withColumn("_copy", F.row_number().over(alike.orderBy("bucket", "row"))).join(took, ["no", "bucket", "row"])
    took = took.select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_n"), "_copy", "_taken", "_slot")
    text = F.col(f"_row.`{text_col}`")
    size = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select("_row", F.col(f"_row.`{id_col}`").alias("id"), F.col(f"_row.`{source_col}`").alias("source"), size.alias("size"))
    # Which copy a row is, matters to nothing but the count of them.
    whole = whole.withColumn("_at", F.row_number().over(alike.orderBy(F.xxhash64(text))))
    joined = whole.join(took, F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_n")) & (F.col("_at") == F.col("_copy")))
    is_whole = F.col("_taken") == F.col("size")
    out = {text_col: F.when(is_whole, text).otherwise(F.array_join(F.slice(words(text), F.lit(1), F.col("_taken").cast("int")), " "))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(is_whole, F.col("_row.n_chars")).otherwise(F.char_length(out[text_col])).cast(docs.schema["n_chars"].dataType)
    dealt = joined.withColumn("_stretch", F.expr(f"_slot div {DEALT}")).repartition("_stretch").sortWithinPartitions("_slot", "_id")
    return dealt.select(*[out.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


_BLOCK = 4096
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight FROM d GROUP BY source),
     o AS (SELECT *, 2 * source_size AS cap, coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                  sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM s),
     l AS (SELECT *, (1.5 * total - before) / rest AS level FROM o),
     m AS (SELECT min_by(level, cap / weight) FILTER (level * weight < cap) AS level FROM l),
     t AS (SELECT source, no, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM m), 1e300) * weight) AS target FROM l),
     g AS (SELECT *, floor(target)::BIGINT AS goal, sum(floor(target)::HUGEINT) OVER (ORDER BY no) AS upto, sum(floor(target)::HUGEINT) OVER () AS whole FROM t),
     h AS (SELECT *, (upto - goal) * {CIRCLE} // greatest(whole, 1) AS low, upto * {CIRCLE} // greatest(whole, 1) AS high, (goal + {_BLOCK - 1}) // {_BLOCK} AS need, (whole + {_BLOCK - 1}) // {_BLOCK} AS n_slots FROM g),
     i AS (SELECT unnest(range((SELECT coalesce(max(n_slots), 0)::BIGINT FROM h))) AS slot),
     r AS (SELECT slot, no, need, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS block FROM i JOIN h ON (slot % {CIRCLE}) * {STEP} % {CIRCLE} >= low AND (slot % {CIRCLE}) * {STEP} % {CIRCLE} < high),
     c AS (SELECT no, max(n_slots)::BIGINT AS n_slots, max(need) AS need, count(r.slot) AS given FROM h LEFT JOIN r USING (no, need) GROUP BY no),
     q AS (SELECT slot, row_number() OVER (ORDER BY slot) AS turn FROM r WHERE block >= need),
     y AS (SELECT no, n_slots, block, row_number() OVER (ORDER BY block, no) AS turn FROM (SELECT no, n_slots, unnest(range(given, need::BIGINT)) AS block FROM c WHERE given < need)),
     z AS (SELECT slot, no, block FROM r WHERE block < need UNION ALL SELECT coalesce(slot, n_slots + turn - 1 - (SELECT count(*) FROM q)), no, block FROM y LEFT JOIN q USING (turn)),
     p AS (SELECT rid, doc_id, no, size, source_size, target, goal,
                  coalesce(sum(size) OVER (PARTITION BY h.source ORDER BY md5('17:' || coalesce(doc_id::VARCHAR, 'null')), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
           FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
     e AS (SELECT rid, no, k * source_size + start AS a, least(k * source_size + start + size, goal) AS b FROM p, (SELECT unnest([0, 1]) AS k) WHERE size > 0),
     w AS (SELECT rid, min(slot) AS first_slot, count(*) AS pieces FROM (SELECT rid, no, unnest(range(a // {_BLOCK}, (b - 1) // {_BLOCK} + 1)) AS block FROM e WHERE a < b) JOIN z USING (no, block) GROUP BY rid)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, goal) - start) + greatest(0, least(source_size + start + size, goal) - source_size - start))::BIGINT AS taken,
       first_slot::BIGINT AS first_slot, coalesce(pieces, 0)::BIGINT AS pieces FROM p LEFT JOIN w USING (rid)"""


def query(spark, sf_dir: str) -> DataFrame:
    return taken_words(*mix(table(spark, sf_dir, "documents"))).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot", "pieces")
