"""Models that last: a configuration's cohorts learn tables one after another, and score others with what they have learned.

learn() reads the states of the keys that a table names, learns its rows as if they followed all earlier ones, and adds the new
states to a ModelStore: moments, values with their ids and counts, window masses, axes, template miners and networks. Learning in parts
leaves what learning at once does. score() joins events with states and changes nothing; ids that unseen values get while
they are scored are not kept.

What a cohort refuses does not reach the cohorts after it. Rows of a key that is still warming up wait, as they came, and are
learned with those that end its warm-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from outlyr import extensions
from outlyr.config import Cohort, Config, encoder_of
from outlyr.operators import encoders, projection, trees, windows
from outlyr.operators.sequential import STATE
from outlyr.plans.engine import ORDER, Engine, Known
from outlyr.session import scratch
from outlyr.sources import sinks
from outlyr.sources.models import ModelStore

SCALED = ("StandardScaler", "MinMaxScaler")
#: Encoders that keep values: with ids, and with counts.
NUMBERED, COUNTED = ("LabelIndex", "OneHotEncoder"), ("FrequencyEncoder",)
#: What stands in place of a field's name where a state is that of the whole network.
NETWORK = ""


class Stored(Known):
    """What a store holds of a cohort."""

    def __init__(self, service: Service, cohort: str, keeps: bool = False):
        self.service, self.store, self.cohort, self.keeps = service, service.store, cohort, keeps
        self.handed_on: dict[str, DataFrame] = {}

    def _of(self, kind: str, field: str) -> DataFrame:
        return self.store.load(kind, self.cohort).filter(F.col("field") == field)

    def moments(self, field: str) -> DataFrame:
        return self._of("moments", field).filter("n is not null").select("key", *encoders.MOMENTS)

    def values(self, field: str) -> DataFrame:
        return self._of("values", field).filter("id is not null or n is not null").select("key", "value", "id", "n")

    def templates(self, field: str) -> DataFrame:
        return self._of("sequences", field).filter("state is not null").select("key", "state")

    def kept_templates(self, field: str, found: DataFrame) -> DataFrame:
        if not self.keeps:
            return found
        found = self.service.kept(found, "templates")
        self.handed_on[field] = found.filter(F.col(STATE).isNotNull()).select("key", F.col(STATE).alias("state"))
        return found.filter(F.col(STATE).isNull()).drop(STATE)

    def axes(self, field: str) -> DataFrame:
        return self._of("axes", field).filter("axes is not null").select(F.col("key").alias("_key"), F.col("axes").alias("_axes"))

    def own(self, field: str) -> DataFrame:
        return self._of("own", field).filter("state is not null").select("key", "state")

    def keys(self) -> DataFrame:
        return self.store.load("keys", self.cohort).select(F.col("key").alias("_k"), F.col("events").alias("_events"), F.col("trained").alias("_trained"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


class Service(Engine):
    def __init__(self, spark: SparkSession, config: Config, path: str | None = None, block: Column | None = None, store: ModelStore | None = None):
        """path: where the models lie; else the configuration's database names it. store: another store with the same methods."""
        super().__init__(config, block)
        path = path or config.database.get("path")
        if store is None and not path:
            raise ValueError("the configuration's database names no path")
        self.spark, self.store = spark, store or ModelStore(spark, path)

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """df written beside the models and read again, for what a step reads more than once."""
        path = scratch(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # Learning

    def learn(self, events: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Learns seq and payload of events, in the order of seq, and gives the version that holds the models after them.

        batch: a stream's name and its micro-batch, which are noted in the same step.
        """
        version = self.store.version() + 1
        self.store.discard(version)
        rows, names = self._extracted(events.select(F.lit(0).alias("phase"), "seq", "payload"))
        # Only a cohort that warms up keeps events as they came.
        json = F.to_json("payload") if any(c.warmup for c in self.config.cohorts) else F.lit(None).cast("string")
        rows = rows.withColumns({f"key_{i}": self._key(c) for i, c in enumerate(self.config.cohorts)} | {"json": json}).drop("payload")
        rows = self.kept(rows, "extracted")
        states: dict[str, list[DataFrame]] = {}
        for i, cohort in enumerate(self.config.cohorts):
            used = rows.filter(self._error(i + 1).isNull()).select("phase", "seq", F.col(f"key_{i}").alias("key"), *names[cohort.features].values(), "json")
            made, refused = self._learned_by(cohort, used, names[cohort.features])
            for kind, state in made.items():
                states.setdefault(kind, []).append(state.withColumn("cohort", F.lit(cohort.name)))
            if refused is not None and i + 1 < len(self.config.cohorts):
                rows = rows.join(refused, "seq", "left_anti")
        if batch is not None:
            self.store.save("batches", self.spark.createDataFrame([batch], "stream string, batch long").withColumn("at", F.current_timestamp()), version)
        # The keys come last: they end the step.
        for kind in sorted(states, key=lambda k: k == "keys"):
            both = states[kind][0]
            for more in states[kind][1:]:
                both = both.unionByName(more)
            self.store.save(kind, both, version)
        return version

    def learn_stream(self, events: DataFrame, checkpoint: str, name: str = "events") -> DataStreamWriter:
        """A stream of seq and payload that is learned batch by batch, each once: start it with .start().

        A batch that is delivered again, after a restart or a lost driver, is in the models already and passes.
        """

        def step(batch: DataFrame, number: int) -> None:
            if not self.store.has_batch(name, number):
                self.learn(batch, (name, number))

        return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)

    def score_stream(self, events: DataFrame, checkpoint: str, path: str, explain: bool = False) -> DataStreamWriter:
        """A stream of seq and payload that is scored by the models of each batch's moment; answers go to path/batch=N as JSON.

        A batch that is delivered again takes the place of its answers. With debug.dump_results, inputs are written beside them.
        """

        def step(batch: DataFrame, number: int) -> None:
            sinks.dump(self.score(batch, explain), f"{path}/batch={number}", batch if self.config.dump_results else None)

        return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)

    def _warmed(self, cohort: Cohort, used: DataFrame, names: dict[str, str]) -> tuple[DataFrame, DataFrame]:
        """Rows of keys that have warmed up, those included that have waited for it, and new rows that wait (key, seq, json)."""
        waited = self.store.load("waiting", cohort.name).select("key", "step", "seq", "json")
        known = Stored(self, cohort.name).keys()
        cold = waited.join(known, _same("key", "_k"), "left_anti")
        now = used.groupBy("key").agg(F.count("*").alias("n"))
        counts = cold.groupBy("key").agg(F.count("*").alias("n")).unionByName(now).groupBy("key").agg(F.sum("n").alias("n"))
        counts = counts.join(known, _same("key", "_k"), "left").join(now.select(F.col("key").alias("_now")), _same("key", "_now"), "left_semi")
        warm = self.kept(counts.filter(F.col("_events").isNotNull() | (F.col("n") >= cohort.warmup)).select(F.col("key").alias("_warm")), "warm")
        # What has waited comes before all that is new, in the order of the steps that it came with.
        place = F.row_number().over(Window.partitionBy("key").orderBy("step", "seq")) - (1 << 62)
        cold = cold.join(warm, _same("key", "_warm"), "left_semi").withColumn("seq", place)
        again, own = self._extracted(cold.select(F.lit(0).alias("phase"), "seq", F.try_parse_json("json").alias("payload"), "key", "json"))
        again = again.select("phase", "seq", "key", *[F.col(own[cohort.features][n]).alias(c) for n, c in names.items()], "json")
        ready = again.unionByName(used.join(warm, _same("key", "_warm"), "left_semi"))
        return ready, used.join(warm, _same("key", "_warm"), "left_anti").select("key", F.lit(self.store.version() + 1).cast("long").alias("step"), "seq", "json")

    def _learned_by(self, cohort: Cohort, used: DataFrame, names: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame | None]:
        """The states of a cohort after used, by kind, and the seq of what it refused."""
        out, known = {}, Stored(self, cohort.name, keeps=True)
        if cohort.warmup and cohort.model != "NoOp":
            used, out["waiting"] = self._warmed(cohort, used, names)
        used = used.drop("json").join(known.keys(), _same("key", "_k"), "left").drop("_k")
        if cohort.model == "NoOp":
            events = used.groupBy("key").agg((F.coalesce(F.max("_events"), F.lit(0)) + F.count("*")).alias("events"))
            return {"keys": events.withColumn("trained", F.col("events"))}, None
        if cohort.warmup:
            number = F.coalesce("_events", F.lit(0)) + F.row_number().over(Window.partitionBy("key").orderBy(*ORDER))
            used = used.withColumn("number", number)
        rows, features, error = self._features(used, cohort, names, known)
        numbers = [(f.name, f"{f.name}__{i}", c, f.limits) for f in features if not f.is_category for i, c in enumerate(f.columns)]
        rows = rows.withColumn("failed", error)
        by_trees, categories = bool(numbers) and cohort.model == "HalfSpaceTrees", [c for f in features if f.is_category for c in f.columns]
        columns = [c for _, _, c, _ in numbers] + categories
        if by_trees:
            forests, window = self._forests(cohort, numbers)
            rows, columns = self._vectors(rows, numbers, forests), ["features"]
        elif numbers and cohort.model in extensions.MODELS:
            rows, columns = self._vectors(rows, numbers), ["features"]
        given = {n: f"n{k}" for k, n in enumerate(names) if encoder_of(self._field(cohort, n), cohort.model) in NUMBERED}
        rows = self.kept(rows.select("key", *ORDER, "_events", "_trained", "failed", *dict.fromkeys([*columns, *names.values(), *given.values()])), "encoded")
        self._values(out, known, cohort, rows, names, given)
        if cohort.model == "Autoencoder":
            said = self.kept(self._networks(rows, cohort, names, categories, numbers, known.templates(NETWORK), finish=True), "networks")
            known.handed_on[NETWORK] = said.filter(F.col(STATE).isNotNull()).select("key", F.col(STATE).alias("state"))
            late = said.filter("error is not null").select(F.col("seq").alias("_seq"), F.col("error").alias("_late"))
            rows = rows.join(late, F.col("seq") == F.col("_seq"), "left").withColumn("failed", F.coalesce("failed", "_late")).drop("_seq", "_late")
        for field, state in known.handed_on.items():
            state = state.withColumn("field", F.lit(field))
            out["sequences"] = out["sequences"].unionByName(state) if "sequences" in out else state
        counts = rows.groupBy("key").agg((F.coalesce(F.max("_events"), F.lit(0)) + F.count("*")).alias("events"), F.coalesce(F.max("_trained"), F.lit(0)).alias("_before"), F.count_if(F.col("failed").isNull()).alias("_new"))
        out["keys"] = counts.select("key", "events", (F.col("_before") + F.col("_new")).alias("trained"))
        if numbers and cohort.model in extensions.MODELS:
            train = rows.filter("failed is null").select("key", *ORDER, "features")
            state = extensions.MODELS[cohort.model].fit(train, cohort.params, known.own(NETWORK)).withColumn("field", F.lit(NETWORK))
            out["own"] = out["own"].unionByName(state) if "own" in out else state
        if by_trees:
            out["masses"] = self._masses(cohort, rows.filter("failed is null"), counts, forests, window)
        return out, rows.filter("failed is not null").select("seq")

    def _values(self, out: dict[str, DataFrame], known: Stored, cohort: Cohort, rows: DataFrame, names: dict[str, str], given: dict[str, str]) -> None:
        """Adds the moments and values of each field to out."""

        def add(kind: str, state: DataFrame, field: str) -> None:
            state = state.withColumn("field", F.lit(field))
            out[kind] = out[kind].unionByName(state) if kind in out else state

        touched = rows.select(F.col("key").alias("_touched")).distinct()
        for name, c in names.items():
            encoder = encoder_of(self._field(cohort, name), cohort.model)
            if encoder in SCALED:
                now = encoders.fitted(rows, c, ["key"])
                before = known.moments(name).join(touched, _same("key", "_touched"), "left_semi")
                add("moments", encoders.merged(before, now, ["key"]), name)
            elif encoder in extensions.ENCODERS and extensions.ENCODERS[encoder].fit is not None:
                add("own", extensions.ENCODERS[encoder].fit(rows, c, self._field(cohort, name).params, known.own(name)), name)
            elif encoder == "SentenceTransformerEncoder" and cohort.warmup:
                vectors = rows.select("key", *ORDER, projection.hashed_vector(F.when(F.btrim(F.col(c)) != "", F.col(c))).alias("v")).join(known.axes(name).select(F.col("_key").alias("_b")), _same("key", "_b"), "left_anti")
                dim = self._field(cohort, name).params.get("embed_dim", 8)
                add("axes", self._axes_of(vectors, "v", cohort.warmup, dim).select(F.col("_key").alias("key"), F.col("_axes").alias("axes")), name)
            elif encoder in (*NUMBERED, *COUNTED):
                id_ = F.first(given[name]).cast("int") if name in given else F.lit(None).cast("int")
                now = rows.filter(F.col(c).isNotNull()).groupBy("key", F.col(c).cast("string").alias("value")).agg(id_.alias("id"), F.count("*").alias("_n"))
                old = known.values(name).select(F.col("key").alias("_key"), F.col("value").alias("_value"), F.col("n").alias("_before"))
                now = now.join(old, _same("key", "_key") & _same("value", "_value"), "left")
                add("values", now.select("key", "value", "id", (F.col("_n") + F.coalesce("_before", F.lit(0))).alias("n")), name)

    def _masses(self, cohort: Cohort, train: DataFrame, counts: DataFrame, forests: list[trees.Forest], window: int) -> DataFrame:
        """key, slice, window, sums, counts, mass of the windows that a key may score by or is filling, after train.

        They lie in the last 2 * window rows of a key, of which Spark keeps as many for each task before the shuffle.
        """
        back = F.row_number().over(Window.partitionBy("key").orderBy(*[F.col(c).desc() for c in ORDER]))
        last = train.select("key", *ORDER, "features").withColumn("_back", back).filter(F.col("_back") <= 2 * window)
        held = counts.select(F.col("key").alias("_k"), (F.col("_before") + F.col("_new")).alias("_all"))
        last = last.join(held, _same("key", "_k")).drop("_k").withColumn("at", F.col("_all") - F.col("_back") + 1)
        each = [F.struct(F.lit(k).cast("long").alias("slice"), windows.window_id(F.col("at"), window, o).cast("long").alias("window"), windows.window_id(F.col("_all"), window, o).cast("long").alias("now")) for k in range(len(forests)) for o in [windows.slice_offset(k, window, len(forests))]]
        # The window that is being filled and the whole one before it; one that has just been filled is its own last.
        placed = last.select("key", "features", F.inline(F.array(*each))).filter("window >= 0 and window >= now - 1").drop("now")
        keys = ["key", "slice", "window"]
        n = len(forests[0].names)
        value = lambda i: F.get("features", F.lit(i))
        sums = placed.groupBy(*keys).agg(F.array(*[F.coalesce(F.sum(value(i)), F.lit(0.0)) for i in range(n)]).alias("sums"), F.array(*[F.count(value(i)) for i in range(n)]).alias("counts"))
        now = sums.join(trees.masses(placed, keys, forests, "features", "slice"), keys)
        old = self.store.load("masses", cohort.name).filter("mass is not null").select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in ("sums", "counts", "mass")])
        both = now.join(old, _same("key", "_key") & (F.col("slice") == F.col("_slice")) & (F.col("window") == F.col("_window")), "left")
        added = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.zip_with(a, b, lambda x, y: x + y))
        mass = F.when(F.col("_mass").isNull(), F.col("mass")).otherwise(F.zip_with("mass", "_mass", lambda x, y: F.zip_with(x, y, lambda u, v: u + v)))
        return both.select(*keys, added("sums", "_sums").alias("sums"), added("counts", "_counts").alias("counts"), mass.alias("mass"))

    # Scoring

    def _model(self, cohort: Cohort, window: int, slices: int) -> DataFrame:
        """key, slice, age, mean, mass of each key that has had a whole window and has warmed up."""
        keys = self.store.load("keys", cohort.name).filter(F.col("trained") >= cohort.warmup)
        active = keys.select(F.col("key").alias("_key"), windows.active_slice(F.col("trained"), window, slices).alias("_a")).filter("_a is not null")
        held = self.store.load("masses", cohort.name).filter("mass is not null")
        joined = held.join(active, _same("key", "_key") & (F.col("slice") == F.col("_a.slice")) & (F.col("window") == F.col("_a.window")))
        mean = F.zip_with("sums", "counts", lambda s, n: F.coalesce(F.try_divide(s, n), F.lit(0.0)))
        return joined.select("key", "slice", F.col("_a.age").alias("age"), mean.alias("mean"), "mass")

    def _scored_by(self, cohort: Cohort, asked: DataFrame, names: dict[str, str], explain: bool) -> DataFrame:
        untold = self._told(explain, self._shown(names, [], F.lit(False)), F.lit(None), None)
        none = asked.select("seq", "key", F.lit(None).cast("double").alias("anomaly_score"), F.lit(None).cast("string").alias("failed"), F.create_map().cast("map<string,long>").alias("properties"), untold.alias("explanation"))
        if cohort.model == "NoOp":
            return none
        known = Stored(self, cohort.name)
        if cohort.warmup:
            # Nothing that is scored waits.
            asked = asked.withColumns({"number": F.lit(None).cast("int"), "_events": F.lit(0)})
        rows, features, error = self._features(asked, cohort, names, known)
        numbers = [(f.name, f"{f.name}__{i}", c, f.limits) for f in features if not f.is_category for i, c in enumerate(f.columns)]
        rows = rows.withColumn("failed", error)
        if cohort.model == "Autoencoder":
            # Read twice where explanations are asked for.
            rows = self.kept(rows, "asked") if explain else rows
            said = self._networks(rows, cohort, names, [c for f in features if f.is_category for c in f.columns], numbers, known.templates(NETWORK))
            return self._by_network(said, rows, names, features, explain)
        if not numbers:
            return none
        if cohort.model in extensions.MODELS:
            return self._by_extension(self._vectors(rows, numbers), known.own(NETWORK), cohort, names, features, explain)
        forests, window = self._forests(cohort, numbers)
        rows = self._vectors(rows, numbers, forests)
        return self._by_trees(rows, self._model(cohort, window, len(forests)), names, features, numbers, forests, window, explain)

    def score(self, events: DataFrame, explain: bool = False) -> DataFrame:
        """The response to each of events, as run() gives it, from the models that have been learned."""
        rows, names = self._extracted(events.select(F.lit(1).alias("phase"), "seq", "payload"))
        rows = self._once(rows)
        parts = None
        for i, cohort in enumerate(self.config.cohorts):
            asked = rows.filter(self._error().isNull()).select(*ORDER, F.col(f"key_{i}").alias("key"), *names[cohort.features].values())
            one = self._one_of(i, cohort, self._scored_by(cohort, asked, names[cohort.features], explain))
            parts = one if parts is None else parts.unionByName(one)
        return self._answers(rows, parts)
