"""N-gram Jaccard join: a grouped prefix join over the word shingles of whole texts.

Two sets whose Jaccard similarity is percent/100 or more share one of the first n - ceil(percent * n / 100) + 1 shingles of
each, in any order that holds for all sets. The order here is: rare shingles first, then frequent ones by their count.

1. Shingle counts over all texts, combined in each task and packed as sorted differences, give the frequent shingles (any
   set of them gives a right order; only the speed depends on it, so a bounded number is broadcast).
2. Texts with one size and one prefix form a group. Groups meet on prefix shingles that two or more of them hold.
3. First pass: each group meets the group that leads each of its shingles, and each member its group's first; pairs are
   verified on whole sets, and links become components.
4. Second pass: all pairs of members that share a prefix shingle or a group and are in different components, and that size
   and place do not rule out. What is in one component needs no further test, so a large group of copies costs its size,
   not its square, and every link between components is found.

Sets are verified whole, as 64-bit hashes of their shingles; sets are told apart by 128-bit hashes, groups by 64-bit ones.
What is read more than once is written to the shared folder and deleted when it is spent.

Nulls and empty texts have empty sets and are linked with nothing. Texts of fewer words than a shingle are one shingle;
texts of any length are read whole, a slice of texts at a time. Copies and repeated rows share one set and one component.
Null ids are kept, and count in no component's smallest id. An empty table gives no rows. Ties: of rows with one id the
smallest id is that id; deduplicated() says which row of a component it keeps. Only the two named columns are read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlyr.llm.common import discard, slices, small_batches, table, written
from outlyr.llm.shingles import shingle_sets

#: Shingles held by more sets than this count as frequent; at most so many of them are broadcast, the most frequent first.
FREQUENT_ABOVE, FREQUENT_MOST = 16, 1 << 18
#: Bits of a shingle by which it is counted, and buckets in which counts are added up for each task that reads texts.
COUNT_BITS, BUCKETS_A_TASK = 40, 4
#: Bits of the filter that spares texts outside all pairs, for each text in a pair, and at most (what is broadcast).
FILTER_BITS_A_TEXT, FILTER_MOST = 16, 1 << 28
#: Bytes of text whose sets a task makes at once, and shingles that it gathers before it counts them.
SLICE, HELD = 1 << 18, 1 << 20
#: Links for each task that makes stars of them, and nodes that a task holds at most at once, as tasks are not quite even.
LINKS_A_TASK, FOREST = 1 << 15, 1 << 18


def set_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches, each with the sets of its texts; a task holds the sets of one slice."""
    with np.errstate(over="ignore"):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                yield batch, shingle_sets([t or "" for t in batch.column("text").to_pylist()], size)


def fingerprint(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _planes(numbers: np.ndarray, n: int) -> bytes:
    """Numbers below 256^n, byte by byte of all of them, so that high bytes of zero compress."""
    return numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    wide = np.zeros((len(data) // n, 8), np.uint8)
    wide[:, :n] = np.frombuffer(data, np.uint8).reshape(n, -1).T
    return wide.view(np.uint64).ravel()


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edges = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
    return keys[edges], np.add.reduceat(counts, edges) if len(edges) else counts


def frequent(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles' leading bits, sorted, and their counts.

    A task adds up what it has gathered before anything is shuffled, so a shingle that most texts hold is as many entries
    as tasks gather, not as there are texts; buckets grow in number with the tasks.
    """
    buckets = max(64, BUCKETS_A_TASK * texts.rdd.getNumPartitions())
    drop = np.uint64(64 - COUNT_BITS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            each, times = np.unique(np.concatenate(held) >> drop, return_counts=True)
            bucket = (each * np.uint64(buckets)) >> np.uint64(COUNT_BITS)
            edges = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
            keys = [_planes(np.diff(p, prepend=np.uint64(0)), 5) for p in np.split(each, edges[1:])]
            counts = [_planes(p, 4) for p in np.split(times, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[edges].astype(np.int64)), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "keys", "counts"])

        for _, sets in set_batches(batches, size):
            for s in sets:
                f = fingerprint(s.tobytes())
                if f not in seen and len(s):
                    seen.add(f)
                    held.append(s)
                    n += len(s)
            if n > HELD:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def total(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(_numbers(p, 5), dtype=np.uint64) for p in group.column("keys").to_pylist()]
        keys, counts = _added(np.concatenate(keys), np.concatenate([_numbers(p, 4) for p in group.column("counts").to_pylist()]))
        often = counts > FREQUENT_ABOVE
        return pa.table({"shingle": keys[often].astype(np.int64), "n": counts[often].astype(np.int64)})

    counts = texts.select("text").mapInArrow(partial, "bucket long, keys binary, counts binary").groupBy("bucket").applyInArrow(total, "shingle long, n long")
    # At most FREQUENT_MOST reach the driver: those above the least count that leaves no more.
    counts = written(counts, "counts")
    step = F.floor(F.log2("n") * 8)
    gathered, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("shingles"), F.min("n").alias("least")).collect(), key=lambda r: -r.step):
        gathered += r.shingles
        if gathered > FREQUENT_MOST:
            break
        least = r.least
    most = counts.filter(F.col("n") >= least).toPandas().sort_values("shingle") if least is not None else None
    discard(counts)
    if most is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return most["shingle"].to_numpy(np.uint64), most["n"].to_numpy(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n + percent * -n // 100 + 1


def prefixes(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """id, h (the text), n, fp (the set), g (the group), prefix (where a task meets a group first), written."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent(texts, size))
    drop = np.uint64(64 - COUNT_BITS)

    def order(s: np.ndarray) -> np.ndarray:
        common, often = shared.value
        if not len(common):
            return s
        leading = s >> drop
        at = np.minimum(np.searchsorted(common, leading), len(common) - 1)
        late = common[at] == leading
        if not late.any():
            return s
        rest = s[late]
        return np.concatenate((s[~late], rest[np.argsort(often[at[late]], kind="stable")]))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, sets in set_batches(batches, size):
            fps, gs, heads = [], [], []
            for s in sets:
                head = order(s)[: prefix_length(len(s), percent)] if len(s) else s
                g = int.from_bytes(fingerprint(len(s).to_bytes(8, "little") + head.tobytes())[:8], "little", signed=True)
                fps.append(fingerprint(s.tobytes()))
                gs.append(g)
                heads.append(None if g in seen or not len(s) else head.view(np.int64))
                seen.add(g)
            own = [batch.column("id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, pa.array(fps, pa.binary()), pa.array(gs, pa.int64()), pa.array(heads, pa.list_(pa.int64()))], ["id", "h", "n", "fp", "g", "prefix"])

    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.select("id", F.xxhash64("text").alias("h"), "text")
    out = written(rows.mapInArrow(first, f"id {kind}, h long, n long, fp binary, g long, prefix array<long>"), "prefixes")
    shared.destroy()
    return out


def _may_link(n1: Column, at1: Column, n2: Column, at2: Column, percent: int) -> Column:
    """What sizes and the places of a first common shingle allow."""
    least, most = F.least(n1, n2), F.greatest(n1, n2)
    rest = F.least(n1 - at1, n2 - at2)
    return (least * 100 >= most * percent) & (rest * (100 + percent) >= (n1 + n2) * percent)


def hidden(key: str) -> Column:
    """A key whose expression hides how its table is dealt.

    A table of one row a key that was made by an aggregate is dealt by that key already, and would be joined in the task
    that made it. Behind this, both sides are dealt for the join alone, and adaptive execution can split a hot key's rows.
    """
    return F.concat(F.col(key), F.unhex(F.lit("")))


def hidden_number(key: str) -> Column:
    """The same for a number."""
    return F.bitwise_not(F.bitwise_not(F.col(key)))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is percent / 100 or more.

    The set of b, which many pairs may have, is joined to their short rows; then pairs are dealt by a, with whole sets.
    """
    right = pairs.join(sets.select(F.col("fp").alias("b"), F.col("set").alias("sb")), "b")
    both = right.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("sa")), "a")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.filter(same * (100 + percent) >= (F.size("sa") + F.size("sb")) * percent).select("a", "b")


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: u, and the smallest node v that it reaches by them."""
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        top = x
        while top in up:
            top = up[top]
        while x != top:
            up[x], x = top, up[x]
        return top

    def stars() -> pa.RecordBatch:
        us = list(up)
        return pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array([root(u) for u in us], pa.binary())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            low, high = sorted((root(u), root(v)))
            if low != high:
                up[high] = low
        if len(up) > FOREST:
            yield stars()
            up.clear()
    yield stars()


def components(links: DataFrame) -> DataFrame:
    """fp, label of each end of links (a table that was written), written: the smallest fp that it reaches.

    Tasks grow in number with the links, and each makes stars of its own; if one takes all links, its stars are the components.
    Otherwise stars meet in rounds. A node has at most one neighbour for each task that met it; all of them go to the
    smallest, and who points to a node that points on is handed on. When no node has several neighbours and none is handed
    on, the stars are the components. Nodes that many point to are keys of a join alone, whose rows adaptive execution can
    split, so no list of a star's nodes is gathered.
    """
    tasks = -(-links.count() // LINKS_A_TASK) or 1
    edges, more, spent = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), True, []
    while more:
        stars = edges.select("u", "v").coalesce(tasks).mapInArrow(_forests, "u binary, v binary")
        if tasks == 1:
            edges = written(stars, "edges")
            break
        near = written(stars.groupBy("u").agg(F.collect_set("v").alias("near")).select("u", "near", F.array_min("near").alias("m")), "near")
        rows = near.select(F.explode(F.array_append(F.filter("near", lambda v: v != F.col("m")), F.col("u"))).alias("u"), "m", (F.size("near") > 1).alias("several"))
        rows = rows.join(near.select(F.col("u").alias("c"), F.col("m").alias("on")), F.col("m") == hidden("c"), "left")
        edges = written(rows.select("u", F.coalesce("on", "m").alias("v"), (F.col("several") | F.col("on").isNotNull()).alias("more")), "edges")
        discard(near, *spent)
        more, spent = edges.agg(F.max("more")).first()[0], [edges]
    out = edges.select(F.col("u").alias("fp"), F.col("v").alias("label"))
    out.outlyr_path = edges.outlyr_path
    return out


def similar(docs: DataFrame, id_col="doc_id", text_col="text", size: int = 4, percent: int = 85) -> DataFrame:
    """id, n_shingles, component_id, fp (the set), h (the text), label (the component, NULL for an empty set) of each row."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    whole = prefixes(texts, size, percent)
    items = written(whole.filter("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("g").alias("g"), F.min("id").alias("id")), "items")
    # Several tasks may have met a group; its prefix is kept once.
    groups = written(whole.filter("n > 0").groupBy("g").agg(F.first("n").alias("n"), F.min("fp").alias("head"), F.first("prefix", True).alias("prefix")), "groups")
    heads = groups.select("g", "head")

    # Place and size travel as one number.
    entries = groups.select("g", "n", F.posexplode("prefix").alias("at", "shingle"))
    entries = entries.select("shingle", "g", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("n")).alias("at_n"))
    # Any group with the least place will do, so all that is added up are numbers.
    leads = entries.groupBy("shingle").agg(F.min_by("g", "at_n").alias("lead"), F.min("at_n").alias("lead_at_n"), F.count("*").alias("groups")).filter("groups > 1").select(F.col("shingle").alias("key"), "lead", "lead_at_n")
    at, n = lambda c: F.shiftright(c, 32), lambda c: F.col(c).bitwiseAND((1 << 32) - 1)
    met = entries.join(leads, F.col("shingle") == hidden_number("key"))
    met = written(met.select("shingle", "g", n("at_n").alias("n"), at("at_n").alias("at"), "lead", n("lead_at_n").alias("lead_n"), at("lead_at_n").alias("lead_at")), "met")

    first = met.filter("g <> lead").filter(_may_link(F.col("n"), F.col("at"), F.col("lead_n"), F.col("lead_at"), percent)).select("g", "lead").distinct()
    first = first.join(heads.withColumnRenamed("head", "a"), "g").join(heads.select(F.col("g").alias("lead"), F.col("head").alias("b")), "lead").select("a", "b")
    inside = items.join(heads, "g").filter("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    first = written(first.unionByName(inside).distinct(), "first")
    links = _links(texts, items, first, size, percent)
    labels = components(links)

    marked = written(items.join(labels, "fp", "left").select("fp", "g", "n", F.coalesce("label", "fp").alias("label")), "marked")
    parts = marked.select("g", "label").distinct()
    open_ = met.select("shingle", "g", "n", "at").join(parts, "g")
    mixed = open_.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select(F.col("shingle").alias("key"))
    open_ = written(open_.join(mixed, F.col("shingle") == hidden_number("key"), "left_semi"), "open")
    x, y = open_.alias("x"), open_.alias("y")
    may = (F.col("x.label") < F.col("y.label")) & _may_link(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"), percent)
    ends = [F.col(f"{t}.{c}").alias(f"{c[0]}{k}") for k, t in ((1, "x"), (2, "y")) for c in ("g", "label")]
    across = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & may).select(*ends)
    within = parts.alias("x").join(parts.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.label") < F.col("y.label"))).select(*ends)
    across = across.unionByName(within).distinct()
    one = marked.select(F.col("g").alias("g1"), F.col("label").alias("l1"), F.col("fp").alias("a"))
    two = marked.select(F.col("g").alias("g2"), F.col("label").alias("l2"), F.col("fp").alias("b"))
    second = across.join(one, ["g1", "l1"]).join(two, ["g2", "l2"]).select("a", "b").distinct()
    tried = first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    second = written(second.join(tried, ["a", "b"], "left_anti"), "second")
    discard(groups, met, open_, marked)
    if not second.isEmpty():
        more = _links(texts, items, second, size, percent)
        spent, labels = labels, components(links.unionByName(more))
        discard(more, spent)
    found = named(items, labels)
    discard(first, second, links, items, labels)
    return whole.select("id", "h", "n", "fp").join(found, "fp", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "fp", "h", "label")


def named(items: DataFrame, labels: DataFrame) -> DataFrame:
    """fp, component_id (the smallest id of the set's component), label, written; labels has the sets that are linked."""
    known = items.join(labels, "fp", "left").select("fp", "id", F.coalesce("label", "fp").alias("label"))
    least = known.groupBy("label").agg(F.min("id").alias("component_id")).select(F.col("label").alias("key"), "component_id")
    return written(known.join(least, F.col("label") == hidden("key")).select("fp", "component_id", "label"), "found")


def _marked(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter of so many bits: for each hash h of the rows, the bits at two parts of it are set."""
    at = F.explode(F.array(F.pmod("h", F.lit(bits)), F.pmod(F.shiftrightunsigned("h", 32), F.lit(bits)))).alias("at")
    rows = ids.select(at).select((F.col("at") + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in rows:
        out[r.bucket - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.ravel()


def _passes(h: pa.Array, marks: np.ndarray, bits: int) -> np.ndarray:
    """Whether both bits of each hash are set."""
    h = h.to_numpy(zero_copy_only=False).view(np.uint64)
    places = (at % np.uint64(bits) for at in (h, h >> np.uint64(32)))
    return np.logical_and(*((marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool) for at in places))


def sets_of(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """fp, set of the texts of the rows of items that are wanted, written.

    Texts are scanned once; a filter over the wanted ids spares the others, and joins drop what passes it by chance. Rows
    that repeat give a set twice.
    """
    ids = written(wanted.select(F.xxhash64("id").alias("h")), "ids")
    rows = texts.select(F.xxhash64("id").alias("h"), "text")
    n = ids.count()
    bits = max(1 << 20, 1 << (n * FILTER_BITS_A_TEXT - 1).bit_length())
    if bits > FILTER_MOST:
        # Beyond what may be broadcast, a join finds the texts.
        rows, shared = rows.join(ids, "h", "left_semi"), None
    else:
        shared = texts.sparkSession.sparkContext.broadcast(_marked(ids, bits))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = batches if shared is None else (batch.filter(pa.array(_passes(batch.column("h"), shared.value, bits))) for batch in batches)
        for _, sets in set_batches(chosen, size):
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s.tobytes()) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["fp", "set"])

    sets = written(rows.mapInArrow(whole, "fp binary, set array<long>"), "sets")
    discard(ids)
    if shared is not None:
        shared.destroy()
    return sets


def _links(texts: DataFrame, items: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that hold, written: tested on the whole sets of the texts that are in a pair."""
    ends = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    sets = sets_of(texts, items.join(ends, "fp", "left_semi"), size)
    links = written(verified(pairs, sets, percent).distinct(), "links")
    discard(sets)
    return links


def query(spark, sf_dir: str) -> DataFrame:
    found = similar(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def deduplicated(docs: DataFrame, id_col="doc_id", text_col="text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one of each component, and every text without words.

    A component keeps a row of its smallest id; a null id is larger than any. Where several rows of a component have that
    id, the one whose set and text have the smallest hashes stays. Of rows alike in id and text one stays.
    """
    found = similar(docs, id_col, text_col, size, percent)
    first = found.filter("label is not null").filter(F.col("id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("label").agg(F.min(F.struct("fp", "h")).alias("_row"), F.first("id").alias("_id")).select("_id", F.col("_row.h").alias("_h"))
    kept = first.unionByName(found.filter("label is null").select(F.col("id").alias("_id"), F.col("h").alias("_h"))).distinct()
    rows = docs.withColumn("_text_hash", F.xxhash64(f"`{text_col}`"))
    rows = rows.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_h")), "left_semi")
    return rows.dropDuplicates([id_col, "_text_hash"]).drop("_text_hash")
