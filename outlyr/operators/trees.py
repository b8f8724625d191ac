"""Half-space trees as Catalyst expressions.

Trees are drawn by the driver from a seed and the features' ranges alone, so their size is fixed by the configuration. An
event's path through a tree is a chain of child numbers (root 1, children 2i and 2i + 1). Masses are counts of a window's
events at each node; a score sums mass * 2^depth along each tree's path and stops below a node of little mass, that node
included.

    raw = 1 - sum / (trees * window * (2^(height + 1) - 1)),  score = 100 * raw, within 0 and 100
"""

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlyr.operators import windows

#: Share of the window below which a node ends a path.
LITTLE = 0.1
SEED = 42


@dataclass(frozen=True)
class Forest:
    """One slice's trees: feature number and threshold of each inner node, by tree and node."""

    names: tuple[str, ...]
    limits: tuple[tuple[float, float], ...]
    height: int
    feature: tuple[tuple[int, ...], ...]
    threshold: tuple[tuple[float, ...], ...]

    @property
    def trees(self) -> int:
        return len(self.feature)


def default_height(window: int) -> int:
    return max(1, int(math.log2(window / 10))) if window >= 10 else 1


def grow(names: list[str], limits: list[tuple[float, float]], trees: int, height: int, slice_: int = 0) -> Forest:
    """Each feature's work range is drawn around a point of its limits; a node halves the range of a random feature."""
    rng = random.Random(SEED + slice_)
    features, thresholds = [], []
    for _ in range(trees):
        ranges = []
        for low, high in limits:
            s = rng.random()
            r = 2 * max(s, 1 - s)
            ranges.append((low + (s - r) * (high - low), low + (s + r) * (high - low)))
        node_ranges, f, t = {1: ranges}, [0], [0.0]
        for node in range(1, 1 << height):
            mine = node_ranges.pop(node)
            k = rng.randrange(len(names))
            cut = round(sum(mine[k]) / 2, 6)
            f.append(k)
            t.append(cut)
            node_ranges[2 * node] = [*mine[:k], (mine[k][0], cut), *mine[k + 1 :]]
            node_ranges[2 * node + 1] = [*mine[:k], (cut, mine[k][1]), *mine[k + 1 :]]
        features.append(tuple(f))
        thresholds.append(tuple(t))
    return Forest(tuple(names), tuple(limits), height, tuple(features), tuple(thresholds))


def _flat(forests: list[Forest]) -> tuple[Column, Column]:
    numbers = lambda values: F.expr(f"array({', '.join(values)})")
    return numbers(str(x) for fo in forests for tree in fo.feature for x in tree), numbers(f"{x!r}D" for fo in forests for tree in fo.threshold for x in tree)


def paths(features: Column, forests: list[Forest], slice_: Column) -> Column:
    """ARRAY by tree of ARRAY by depth of node numbers, for a feature array (NULL counts as below every threshold)."""
    f, t = _flat(forests)
    trees, height = forests[0].trees, forests[0].height
    nodes = 1 << height

    def down(tree: Column) -> Column:
        base = (slice_ * trees + tree) * nodes

        def step(path: Column, _: Column) -> Column:
            node = F.element_at(path, -1)
            at = (base + node).cast("int")
            value = F.round(F.get(features, F.get(f, at)), 9)
            right = F.coalesce(value >= F.get(t, at), F.lit(False)).cast("int")
            return F.concat(path, F.array(node * 2 + right))

        return F.aggregate(F.sequence(F.lit(1), F.lit(height)), F.array(F.lit(1)), step)

    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), down)


def masses(window_rows: DataFrame, keys: list[str], forests: list[Forest], features: str, slice_: str) -> DataFrame:
    """keys, mass: ARRAY by tree of ARRAY by node of the events of each key's reference window, so a look-up takes one step."""
    nodes = 2 << forests[0].height
    walked = window_rows.select(*keys, F.posexplode(paths(F.col(features), forests, F.col(slice_))).alias("tree", "path"))
    counts = walked.select(*keys, "tree", F.explode("path").alias("node")).groupBy(*keys, "tree", "node").agg(F.count("*").cast("int").alias("n"))
    held = counts.groupBy(*keys, "tree").agg(F.map_from_entries(F.collect_list(F.struct("node", "n"))).alias("held"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(nodes - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0)))
    per = held.select(*keys, "tree", dense.alias("dense")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tree", "dense"))).alias("per"))
    return per.select(*keys, F.transform("per", lambda x: x["dense"]).alias("mass"))


def reference_rows(train: DataFrame, keys: list[str], order: list[str], window: int, slices: int = 1) -> DataFrame:
    """The rows of each key's reference window after its last row, with slice, age and trained (the key's rows).

    The window lies in the last 2 * window rows of a key at most. Spark keeps as many for each task before the shuffle, so
    a key that holds most rows costs no more than others; rows are numbered from the key's count.
    """
    total = train.groupBy(*keys).agg(F.count("*").alias("trained"))
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    rows = train.withColumn("_back", back).filter(F.col("_back") <= 2 * window)
    active = total.withColumn("active", windows.active_slice(F.col("trained"), window, slices)).filter("active is not null")
    active = active.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "trained", "active.slice", "active.window", "active.age")
    joined = rows.join(active, [rows[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys]).drop(*[f"_k_{k}" for k in keys])
    joined = joined.withColumn("at", F.col("trained") - F.col("_back") + 1).drop("_back")
    offset = F.col("slice") * (window // slices)
    return joined.filter(F.floor((F.col("at") - 1 - offset) / window) == F.col("window"))


def fit(train: DataFrame, keys: list[str], order: list[str], features: str, forests: list[Forest], window: int) -> DataFrame:
    """The model of each key that has had a whole window: keys, slice, age, mean (ARRAY), mass (ARRAY by tree and node)."""
    rows = reference_rows(train, keys, order, window, len(forests))
    n = len(forests[0].names)
    means = rows.groupBy(*keys).agg(F.first("slice").alias("slice"), F.first("age").alias("age"), F.array(*[F.coalesce(F.avg(F.get(features, F.lit(i))), F.lit(0.0)) for i in range(n)]).alias("mean"))
    mass = masses(rows, keys, forests, features, "slice")
    return means.join(mass, [means[k].eqNullSafe(mass[k]) for k in keys]).select(means["*"], "mass")


def leaf_sums(mass: Column, height: int, window: int) -> Column:
    """ARRAY by tree of ARRAY by leaf of what a walk to that leaf adds up: a part of the model, so an event looks one number up for each tree."""

    def below(held: Column, leaf: Column, d: int) -> Column:
        """What the path adds from depth d on: a node of little mass ends it."""
        m = F.get(held, F.shiftright(leaf, height - d))
        own = m * float(1 << d)
        return own if d == height else own + F.when(m >= LITTLE * window, below(held, leaf, d + 1)).otherwise(0.0)

    leaves = F.sequence(F.lit(1 << height), F.lit((2 << height) - 1))
    return F.transform(mass, lambda held: F.transform(leaves, lambda leaf: below(held, leaf, 0)))


#: Inner nodes of all walks of a row that are written out as conditions; beyond it, walks are higher-order functions.
WRITTEN_MOST = 8000
#: Levels of a tree that are written out.
WRITTEN_HEIGHT = 7


def _leaf(values: list[str], forest: Forest, tree: int) -> str:
    """The number of the leaf that values (NULL: below every threshold) reach, as nested conditions."""

    def at(node: int) -> str:
        if node >> forest.height:
            return str(node)
        return f"if({values[forest.feature[tree][node]]} >= {forest.threshold[tree][node]!r}D, {at(2 * node + 1)}, {at(2 * node)})"

    return at(1)


def with_scores(df: DataFrame, variants: dict[str, Column], slice_: Column, sums: Column, forests: list[Forest], window: int) -> DataFrame:
    """df with a score for each variant of the features, from 0 (as the window) to 100; NULL where sums (of leaf_sums) are."""
    trees, height, n = forests[0].trees, forests[0].height, len(forests[0].names)
    scale, leaves = float(trees * window * ((2 << height) - 1)), 1 << height
    if height > WRITTEN_HEIGHT or len(variants) * len(forests) * trees * leaves > WRITTEN_MOST:
        reached = lambda f: F.zip_with(sums, paths(f, forests, slice_), lambda s, p: F.get(s, F.element_at(p, -1) - leaves))
        total = lambda f: F.aggregate(reached(f), F.lit(0.0), lambda a, x: a + x)
        return df.withColumns({name: F.when(sums.isNotNull(), score_of(1 - total(f) / scale)) for name, f in variants.items()})
    out = df.withColumns({f"_f{v}_{k}": F.round(F.get(f, F.lit(k)), 9) for v, f in enumerate(variants.values()) for k in range(n)})
    walks = {}
    for v in range(len(variants)):
        values = [f"_f{v}_{k}" for k in range(n)]
        for t in range(trees):
            each = [F.expr(_leaf(values, forest, t)) for forest in forests]
            walks[f"_n{v}_{t}"] = each[0] if len(each) == 1 else F.coalesce(*[F.when(slice_ == k, leaf) for k, leaf in enumerate(each)])
    out = out.withColumns(walks)
    scores = {}
    for v, name in enumerate(variants):
        total = F.lit(0.0)
        for t in range(trees):
            total = total + F.get(F.get(sums, F.lit(t)), F.col(f"_n{v}_{t}") - leaves)
        scores[name] = F.when(sums.isNotNull(), score_of(1 - total / scale))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(name) for name, c in scores.items()])


def score_of(raw: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100))


def limit_error(features: Column, forest: Forest) -> Column:
    """The first feature outside its limits, as an error text."""
    return bounds_error(features, [(name, *limit) for name, limit in zip(forest.names, forest.limits, strict=True)])


def bounds_error(features: Column, bounds: list[tuple[str, float | None, float | None]]) -> Column:
    """The first feature outside its bounds (name, low, high; None: unbounded), as an error text."""
    tests = []
    for i, (name, low, high) in enumerate(bounds):
        if low is None:
            continue
        v = F.get(features, F.lit(i))
        tests.append(F.when((v < low) | (v > high), F.concat(F.lit(f"feature '{name}' = "), v.cast("string"), F.lit(f" is outside expected range [{low}, {high}]"))))
    return F.coalesce(*tests, F.lit(None).cast("string"))


def scored(events: DataFrame, model: DataFrame, keys: list[str], features: str, forests: list[Forest], window: int, explain: bool = False, groups: dict[str, list[int]] | None = None) -> DataFrame:
    """events with score (NULL for a key without a model), reference_age, and, if asked for, explanation.

    explanation: STRUCT<baseline, features>: the score of the window's mean, and of each feature (or group of features, by
    their numbers) what its own values add to it, the largest change first. A group of one shows its value.
    """
    known = model.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("slice").alias("_slice"), F.col("age").alias("reference_age"), F.col("mean").alias("_mean"), leaf_sums(F.col("mass"), forests[0].height, window).alias("_sums"))
    own, mean = F.col("_slice"), F.col("_mean")
    if explain:
        # The mean's score belongs to the model, not to each event.
        known = with_scores(known, {"_base": mean}, own, F.col("_sums"), forests, window)
    joined = events.join(known, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left") if keys else events.join(F.broadcast(known), how="left")
    names = forests[0].names
    grouped = (groups or {n: [i] for i, n in enumerate(names)}) if explain else {}
    only = {f"_o{at}": F.array(*[F.get(F.col(features) if k in part else mean, F.lit(k)) for k in range(len(names))]) for at, part in enumerate(grouped.values())}
    out = with_scores(joined, {"score": F.col(features)} | only, own, F.col("_sums"), forests, window)
    if explain:
        deltas = []
        for at, (name, part) in enumerate(grouped.items()):
            value = F.get(features, F.lit(part[0])) if len(part) == 1 else F.lit(None).cast("double")
            deltas.append(F.struct(F.lit(name).alias("field"), value.alias("value"), (F.col(f"_o{at}") - F.col("_base")).alias("delta"), F.lit(at).alias("at")))
        by_size = lambda a, b: F.when(F.abs(a["delta"]) > F.abs(b["delta"]), -1).when(F.abs(a["delta"]) < F.abs(b["delta"]), 1).otherwise(a["at"] - b["at"])
        listed = F.array_sort(F.array(*deltas), by_size)
        out = out.withColumn("explanation", F.when(F.col("_sums").isNotNull(), F.struct(F.round("_base", 4).alias("baseline"), F.transform(listed, lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"), F.round(x["delta"], 4).alias("delta"))).alias("features"))))
    return out.drop("_slice", "_mean", "_sums", "_base", *only, *[f"_k_{k}" for k in keys])
