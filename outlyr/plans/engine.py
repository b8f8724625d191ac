"""A configuration as two verbs: learn events, score events.

Events are rows of seq (arrival order, unique) and payload (VARIANT). run() learns all of ingest and scores all of score with
the state after it, as a service does that gets one and then the other. Encoders see both in one order, but learn from
ingest alone; ids by first appearance are given to scored rows too.

Cohorts take their rows in the order of the configuration: an event that is refused by one, by what it holds or by a
vocabulary that is full, is learned by those before it alone, and its response says why. A fixed number of window passes, one for each cohort, does the work; for cohorts whose key holds
a large part of all rows, pass block, a value that never falls along seq (such as a day), and scalers add up blocks, with the same results. Where a
cohort has warmup_count, the first rows of a key are scaled by the statistics after the last of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from outlyr import extensions
from outlyr.config import Cohort, Config, Field, encoder_of
from outlyr.functions import extract, labels, paths
from outlyr.operators import autoencoder, composite, drain, encoders, projection, trees
from outlyr.session import scratch

ORDER = ["phase", "seq"]
#: Rows of a block of the arrival order, by which a cohort that holds all rows adds up its statistics.
BLOCK_ROWS = 50_000
SHOWN = "ARRAY<STRUCT<field: STRING, value: STRING, preprocessed: MAP<STRING, ARRAY<DOUBLE>>, raw: MAP<STRING, STRING>>>"
TOLD = "STRUCT<baseline: DOUBLE, features: ARRAY<STRUCT<field: STRING, value: STRING, delta: DOUBLE, preprocessed: MAP<STRING, ARRAY<DOUBLE>>, raw: MAP<STRING, STRING>>>>"


@dataclass(frozen=True)
class Feature:
    """What an encoder makes of a field: columns, and how they are named, bounded and shown."""

    field: str
    name: str  #: the field, or field__bucket
    columns: tuple[str, ...]
    limits: tuple[float, float] | None = None  #: None: the encoder has none
    is_category: bool = False
    key: Column | None = None  #: the name, where it depends on the row
    values: Column | None = None  #: what is shown, where it is not the columns
    raw: Column | None = None

    def shown(self) -> tuple[Column, Column, Column]:
        """Name, values (NULL if absent) and raw text."""
        values = F.array(*[F.col(c).cast("double") for c in self.columns]) if self.values is None else self.values
        return F.lit(self.name) if self.key is None else self.key, F.when(F.col(self.columns[0]).isNotNull(), values), F.lit(None).cast("string") if self.raw is None else self.raw


class Known:
    """What a cohort has learned before: nothing. outlyr.plans.service has one that reads stored states."""

    def moments(self, field: str) -> DataFrame | None:
        """key, n, mean, std, low, high of a field's values."""

    def values(self, field: str) -> DataFrame | None:
        """key, value, id, n: a field's values, their ids by first appearance, and how often they came."""

    def ids(self, field: str, column: str, kind: DataType) -> DataFrame | None:
        found = self.values(field)
        return None if found is None else found.select("key", F.col("value").cast(kind).alias(column), "id")

    def templates(self, field: str) -> DataFrame | None:
        """key, state: what a field's template miners hold."""

    def own(self, field: str) -> DataFrame | None:
        """key, state of an encoder or a model from outside."""

    #: Whether states are handed on.
    keeps = False

    def kept_templates(self, field: str, found: DataFrame) -> DataFrame:
        """found without the states that it hands on, which are kept."""
        return found

    def axes(self, field: str) -> DataFrame | None:
        """_key, _axes of a field whose first vectors have been seen."""


class Engine:
    def __init__(self, config: Config, block: Column | None = None):
        self.config, self.block = config, block

    # Extraction, once for each set of features

    def _extracted(self, events: DataFrame) -> tuple[DataFrame, dict[str, dict[str, str]]]:
        """events with a column for each extracted value and an error for each set of features; the columns by set and name."""
        columns, names, all_made = [], {}, []
        for k, (name, fields) in enumerate(self.config.features.items()):
            made = extract.compile_fields(F.col("payload"), fields, f"_x{k}_")
            all_made.append(made)
            names[name] = {n: f"x{k}_{i}" for i, n in enumerate(made.values)}
            columns += [made.values[n].alias(c) for n, c in names[name].items()] + [made.error.alias(f"error_{name}")]
        return extract.projected(events, all_made).select(*events.columns, *columns), names

    def _field(self, cohort: Cohort, name: str) -> Field:
        """The configured entry of a value, or the type that its expansion gives it."""
        fields = self.config.features[cohort.features]
        if name in fields:
            return fields[name]
        parent = next((f for n, f in fields.items() if name.startswith(f"{n}.")), Field("numeric"))
        return Field("boolean" if name.endswith((".is_weekend", ".is_private")) else "numeric", parent.encoder, parent.params)

    # Encoding

    def _blocks(self, events: DataFrame) -> Column:
        """A block for each stretch of the arrival order: equal parts of its range, of about BLOCK_ROWS rows."""
        low, high, n = events.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
        step = max(1, int((high - low + 1) / max(1, n / BLOCK_ROWS))) if n else 1
        return F.expr(f"seq div {step}")

    def _scaler(self, df: DataFrame, v: str, out: str, kind: str, warmup: int = 0, block: Column | None = None, before: DataFrame | None = None) -> DataFrame:
        """df with out. The first warmup learned rows of a key wait for the statistics after the last of them; NULL if it never comes.

        before: the moments of what each key has learned earlier.
        """
        names = encoders.MOMENTS
        learned = F.when(F.col("phase") == 0, F.col(v))
        if block is not None:
            known = encoders.blocks(df.withColumn("_v", learned), "_v", ["key"], ORDER, F.struct("phase", block)).drop("_v")
        else:
            known = df.withColumns(encoders.statistics(learned, encoders.running(["key"], ORDER)))
        if before is not None:
            old = before.select(F.col("key").alias("_key"), F.struct(*names).alias("_old"))
            known = known.join(old, F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key")
            known = known.withColumns(encoders.together({c: F.col("_old")[c] for c in names}, {c: F.col(c) for c in names})).drop("_old")
        stats = [F.col(c) for c in names]
        waits = F.lit(False)
        if warmup:
            known, waits = self._warm(known, warmup, names, block)
            stats = [F.when(waits, F.col("_then")[c]).otherwise(F.col(c)) for c in names]
        made = encoders.z_score(F.col(v), *stats) if kind == "StandardScaler" else encoders.scaled(F.col(v), *stats[3:])
        if warmup:
            made = F.when(~waits | F.col("_then").isNotNull(), made)
        return known.withColumn(out, made).drop(*names, "_then", "_last")

    def _warm(self, known: DataFrame, warmup: int, names: tuple[str, ...], block: Column | None) -> tuple[DataFrame, Column]:
        """known with _then, the statistics at each key's learned row number warmup, and the rows that wait for them."""
        then = F.struct(*names)
        if block is None:
            at = F.when((F.col("phase") == 0) & (F.col("number") == warmup), then)
            return known.withColumn("_then", F.max(at).over(Window.partitionBy("key"))), (F.col("phase") == 0) & (F.col("number") <= warmup)
        # A limit on the rank keeps warmup rows of a key for each task before the shuffle (up to Spark's threshold, 1000).
        place = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
        # A key that has learned events before has warmed up.
        cold = F.col("_events").isNull() if "_events" in known.columns else F.lit(True)
        last = known.filter((F.col("phase") == 0) & cold).select(F.col("key").alias("_key"), F.col("seq").alias("_last"), then.alias("_then"), place.alias("_at")).filter(F.col("_at") == warmup).drop("_at")
        joined = known.join(last, F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key")
        return joined, cold & (F.col("phase") == 0) & F.coalesce(F.col("seq") <= F.col("_last"), F.lit(True))

    def _axes_of(self, df: DataFrame, vector: str, warmup: int, dim: int) -> DataFrame:
        """_key, _axes: the leading axes of each key's first warmup learned vectors; no row where a key has fewer."""
        if warmup < dim:
            raise ValueError(f"warmup_count {warmup} is below embed_dim {dim}")
        place = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
        first = df.filter((F.col("phase") == 0) & F.col(vector).isNotNull()).select("key", "seq", F.col(vector).alias("v")).withColumn("_place", place).filter(F.col("_place") <= warmup)

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            if len(rows) < warmup:
                return pd.DataFrame({"_key": [], "_axes": []})
            found = projection.leading(np.stack(rows.sort_values("seq")["v"].to_numpy()), dim)
            return pd.DataFrame({"_key": [rows["key"].iloc[0]], "_axes": [found.T.tolist()]})

        # A key's group has warmup rows at most.
        return first.drop("_place").groupBy("key").applyInPandas(fit, "_key string, _axes array<array<double>>")

    def _axes(self, df: DataFrame, vector: str, warmup: int, dim: int, out: str, before: DataFrame | None = None) -> DataFrame:
        """df with out: vectors on the axes of their key; NULL where a key has none. before: axes that are there already."""
        axes = self._axes_of(df, vector, warmup, dim)
        if before is not None:
            axes = before.unionByName(axes.join(before.select(F.col("_key").alias("_b")), F.col("_key").eqNullSafe(F.col("_b")), "left_anti"))
        dot = lambda c: F.aggregate(F.zip_with(vector, c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        joined = df.join(axes, F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key")
        return joined.withColumn(out, F.when(F.col("_axes").isNotNull() & F.col(vector).isNotNull(), F.transform("_axes", dot))).drop("_axes")

    def _encode(self, df: DataFrame, cohort: Cohort, names: dict[str, str]) -> tuple[DataFrame, list[tuple[str, str, tuple[float, float] | None]], list[str], Column]:
        """df with encoded columns; the numeric ones with their names and limits, the categorical ones, and the row's error."""
        df, features, error = self._features(df, cohort, names)
        numbers = [(f.name if len(f.columns) == 1 else f"{f.name}__{i}", c, f.limits) for f in features if not f.is_category for i, c in enumerate(f.columns)]
        return df, numbers, [c for f in features if f.is_category for c in f.columns], error

    def _features(self, df: DataFrame, cohort: Cohort, names: dict[str, str], known: Known | None = None) -> tuple[DataFrame, list[Feature], Column]:
        """df with the columns of its features, and the row's error; known: what the cohort has learned earlier."""
        known = known or Known()
        features, errors = [], [F.lit(None).cast("string")]
        # The rows of a cohort without fields are all in one key.
        block = self.block if self.block is not None else self._blocks(df) if not cohort.fields else None
        ordered = F.struct("phase", block) if block is not None else None
        embedded = cohort.model == "Autoencoder"
        # A cohort that holds few models at a time forgets the ids that it gave while it scored.
        keeps = F.col("phase") == 0 if cohort.lru_size is not None else None
        for k, (name, c) in enumerate(names.items()):
            f = self._field(cohort, name)
            encoder, p, out = encoder_of(f, cohort.model), f.params, f"n{k}"
            text = F.col(c).cast("string")
            if encoder in ("StandardScaler", "MinMaxScaler"):
                df = self._scaler(df, c, out, encoder, cohort.warmup, block, known.moments(name))
                features.append(Feature(name, name, (out,), (-encoders.CLIP, encoders.CLIP) if encoder == "StandardScaler" else None))
            elif encoder == "FrequencyEncoder":
                df = df.withColumn("_v", F.when(F.col("phase") == 0, text))
                if block is not None:
                    # The values of scored rows count in no block, so that they are looked up as texts of their own.
                    df = encoders.frequency_blocks(df.withColumn("_w", text), "_v", ["key"], ORDER, ordered)
                    whole = df.filter("phase = 0 and _v is not null").groupBy("key", "_v").agg(F.count("*").alias("_all_seen"))
                    whole = whole.select(F.col("key").alias("_key"), F.col("_v").alias("_value"), "_all_seen")
                    df = df.join(whole, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_w") == F.col("_value")) & (F.col("phase") == 1), "left").drop("_key", "_value", "_w")
                    df = df.withColumn("seen", F.when(F.col("phase") == 0, F.col("seen")).otherwise(F.coalesce("_all_seen", F.lit(0)))).drop("_all_seen")
                else:
                    df = df.withColumns({"seen": F.count("_v").over(encoders.earlier(["key", c], ORDER)), "before": F.count("_v").over(encoders.earlier(["key"], ORDER))})
                seen, before = F.col("seen"), F.col("before")
                values = known.values(name)
                if values is not None:
                    own = values.select(F.col("key").alias("_key"), F.col("value").alias("_value"), F.col("n").alias("_seen"))
                    all_ = values.groupBy(F.col("key").alias("_all")).agg(F.sum("n").alias("_before"))
                    df = df.join(own, F.col("key").eqNullSafe(F.col("_key")) & (text == F.col("_value")), "left").join(all_, F.col("key").eqNullSafe(F.col("_all")), "left").drop("_key", "_value", "_all")
                    seen, before = seen + F.coalesce("_seen", F.lit(0)), before + F.coalesce("_before", F.lit(0))
                df = df.withColumn(out, F.when(text.isNull(), None).when(before == 0, F.lit(0.0)).otherwise(seen / F.when(before > 0, before))).drop("_seen", "_before", "_v", "seen", "before")
                features.append(Feature(name, name, (out,)))
            elif encoder == "LabelIndex":
                df = encoders.label_index(df, c, ["key"], ORDER, out, known.ids(name, c, df.schema[c].dataType), keeps, ordered)
                features.append(Feature(name, name, (out,), (0.0, float(p.get("expected_categories", 200))), embedded))
            elif encoder == "OneHotEncoder":
                df = encoders.label_index(df, c, ["key"], ORDER, out, known.ids(name, c, df.schema[c].dataType), keeps, ordered)
                n = p.get("n_categories", 10)
                errors.append(encoders.one_hot_error(F.col(out), name, n))
                df = df.withColumns({f"{out}_{i}": F.when(F.col(out).isNotNull(), (F.col(out) == i).cast("double")) for i in range(1, n + 1)})
                features += [Feature(name, f"{name}__{i}", (f"{out}_{i}",)) for i in range(1, n + 1)]
            elif encoder == "HashIndex":
                n = p.get("n_features", 2000)
                df = df.withColumn(out, encoders.hash_index(name, text, n, p.get("seed", 0)))
                features.append(Feature(name, name, (out,), (0.0, float(n)), embedded))
            elif encoder == "OneHotHashEncoder":
                # One of n columns is 1; a fixed set of features holds which one, as its place among all.
                n = p.get("n_features", 1_048_576)
                df = df.withColumn(out, encoders.hash_index(name, text, n, p.get("seed", 0)))
                bucket = F.concat(F.lit(f"{name}__"), F.col(out).cast("string"))
                if not embedded:
                    df = df.withColumn(f"{out}_place", F.col(out) / float(n))
                features.append(Feature(name, name, (out if embedded else f"{out}_place",), None, embedded, bucket, F.array(F.lit(1.0))))
            elif encoder == "Drain3Encoder":
                given = {own: p[k] for k, own in (("similarity", "similarity"), ("most", "most"), ("depth", "depth"), ("sim_th", "similarity"), ("max_clusters", "most")) if k in p}
                slots, n = p.get("max_vars", 20), p.get("n_hash_features", 2000)
                texts, mined = df.select("key", *ORDER, c), {"learns": "phase = 0", "keep": ["phase"], **given}
                before = known.templates(name)
                if block is not None and before is None and not known.keeps:
                    found = drain.templates_by_lead(texts, ["key"], ORDER, c, "seq", block=ordered, **mined)
                else:
                    found = known.kept_templates(name, drain.templates(texts, ["key"], ORDER, c, "seq", before=before, finish=known.keeps, **mined))
                hashed = [encoders.hash_index(name, F.get("variables", F.lit(i)), n, p.get("seed", 0)).alias(f"{out}_v{i}") for i in range(slots)]
                df = df.join(found.select("key", *ORDER, F.col("template_id").alias(out), F.col("template").alias(f"{out}_t"), F.col("variables").alias(f"{out}_w"), *hashed), ["key", *ORDER], "left")
                features.append(Feature(name, f"{name}__template", (out,), (0.0, float(given.get("most", 200))), embedded, raw=F.col(f"{out}_t")))
                features += [Feature(name, f"{name}__var_{i}", (f"{out}_v{i}",), (0.0, float(n)), embedded, raw=F.get(f"{out}_w", F.lit(i))) for i in range(slots)]
            elif encoder == "SentenceTransformerEncoder":
                dim = p.get("embed_dim", 8)
                df = df.withColumn(f"{out}_e", projection.hashed_vector(F.when(F.btrim(text) != "", text)))
                if cohort.warmup:
                    df = self._axes(df, f"{out}_e", cohort.warmup, dim, out, known.axes(name))
                else:
                    df = df.withColumn(out, projection.projected(F.col(f"{out}_e"), projection.matrix(64, dim, p.get("seed", 42))))
                df = df.drop(f"{out}_e").withColumns({f"{out}_{i}": F.get(out, F.lit(i)) for i in range(dim)})
                features.append(Feature(name, name, tuple(f"{out}_{i}" for i in range(dim))))
            elif encoder in extensions.ENCODERS:
                own = extensions.ENCODERS[encoder]
                df, made = own.encode(df, c, out, p, known.own(name))
                features.append(Feature(name, name, tuple(made), own.limits))
            else:
                df = df.withColumn(out, F.when(F.col(c).isNotNull(), 0.0) if encoder == "NoOp" else F.col(c).cast("double"))
                features.append(Feature(name, name, (out,)))
        return df, features, F.coalesce(*errors, F.lit(None).cast("string"))

    def _shown(self, names: dict[str, str], features: list[Feature], encoded: Column) -> Column:
        """The extracted fields of a row with what their encoders made of them; bare where encoded is false."""
        fields = []
        for name, c in names.items():
            parts = [f.shown() for f in features if f.field == name]
            has = lambda x: encoded & x.isNotNull()
            made = F.map_from_entries(F.array_compact(F.array(*[F.when(has(v), F.struct(k.alias("key"), v.alias("value"))) for k, v, _ in parts]))) if parts else F.create_map()
            raw = F.map_from_entries(F.array_compact(F.array(*[F.when(has(v) & r.isNotNull(), F.struct(k.alias("key"), r.alias("value"))) for k, v, r in parts]))) if parts else F.create_map()
            raw = raw.cast("map<string,string>")
            fields.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(name).alias("field"), F.col(c).cast("string").alias("value"), made.cast("map<string,array<double>>").alias("preprocessed"), F.when(F.size(raw) > 0, raw).alias("raw"))))
        return F.array_compact(F.array(*fields)).cast(SHOWN) if fields else F.array().cast(SHOWN)

    def _told(self, explain: bool, shown: Column, baseline: Column, deltas: Column | None) -> Column:
        """The explanation: the fields in the order of deltas (field, delta), or, where a model gives none, as they are, with nothing preprocessed."""
        if not explain:
            return F.lit(None).cast(TOLD)
        part = lambda x, delta, made: F.struct(x["field"].alias("field"), x["value"].alias("value"), delta.cast("double").alias("delta"), made.alias("preprocessed"), x["raw"].alias("raw"))
        bare = F.struct(F.lit(None).cast("double").alias("baseline"), F.transform(shown, lambda x: part(x, F.lit(None), F.create_map().cast("map<string,array<double>>"))).alias("features")).cast(TOLD)
        if deltas is None:
            return bare
        own = lambda d: F.get(F.filter(shown, lambda x: x["field"] == d["field"]), F.lit(0))
        told = F.filter(F.transform(deltas, lambda d: part(own(d), d["delta"], own(d)["preprocessed"])), lambda x: x["field"].isNotNull())
        return F.when(deltas.isNotNull(), F.struct(baseline.alias("baseline"), told.alias("features")).cast(TOLD)).otherwise(bare)

    # Models

    def _cohort(self, events: DataFrame, cohort: Cohort, names: dict[str, str], explain: bool) -> DataFrame:
        """seq, key, anomaly_score, failed, properties, explanation of each scored event."""
        untold = self._told(explain, self._shown(names, [], F.lit(False)), F.lit(None), None)
        none = [F.lit(None).cast("double").alias("anomaly_score"), F.lit(None).cast("string").alias("failed"), F.create_map().cast("map<string,long>").alias("properties"), untold.alias("explanation")]
        if cohort.model == "NoOp":
            return events.filter("phase = 1").select("seq", "key", *none)
        number = F.row_number().over(Window.partitionBy("key").orderBy(*ORDER))
        # Only a warm-up without blocks asks for the number of a row.
        numbered = events.withColumn("number", number) if cohort.warmup and cohort.fields and self.block is None else events
        rows, features, error = self._features(numbered, cohort, names)
        numbers = [(f.name, f"{f.name}__{i}", c, f.limits) for f in features if not f.is_category for i, c in enumerate(f.columns)]
        categories = [c for f in features if f.is_category for c in f.columns]
        rows = rows.withColumn("failed", error)
        if cohort.model == "Autoencoder":
            return self._by_network(self._networks(rows, cohort, names, categories, numbers), rows, names, features, explain)
        if not numbers:
            return events.filter("phase = 1").select("seq", "key", *none)
        if cohort.model in extensions.MODELS:
            train = self._vectors(rows.filter("phase = 0"), numbers).filter("failed is null").select("key", *ORDER, "features")
            state = extensions.MODELS[cohort.model].fit(train, cohort.params, None)
            return self._by_extension(self._vectors(rows.filter("phase = 1"), numbers), state, cohort, names, features, explain)
        forests, window = self._forests(cohort, numbers)
        # Rows are used twice, by the fit and by the scores; the model itself is small.
        train = self._vectors(rows.filter("phase = 0"), numbers, forests).filter("failed is null").select("key", *ORDER, "features")
        model = trees.fit(train, ["key"], ORDER, "features", forests, window)
        if cohort.warmup > window:
            # A key that has not warmed up has learned nothing.
            warm = train.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") >= cohort.warmup).select(F.col("key").alias("_key"))
            model = model.join(warm, F.col("key").eqNullSafe(F.col("_key")), "left_semi")
        return self._by_trees(self._vectors(rows.filter("phase = 1"), numbers, forests), model, names, features, numbers, forests, window, explain)

    def _networks(self, rows: DataFrame, cohort: Cohort, names: dict[str, str], categories: list[str], numbers: list, before: DataFrame | None = None, finish: bool = False) -> DataFrame:
        """What the networks of each key say of encoded rows; those of phase 0 that have not failed are learned."""
        p = {"buffer_size": "buffer", "retrain_every": "every", "epochs_per_retrain": "epochs", "warmup_count": "warmup", "batch_size": "batch", "embed_dim": "embed", "bottleneck": "bottleneck", "vocab_headroom": "headroom", "lr": "rate", "seed": "seed"}
        given = {p[k]: v for k, v in cohort.params.items() if k in p and v is not None} | ({"warmup": cohort.warmup} if cohort.warmup else {})
        rows = rows.withColumn("learns", (F.col("phase") == 0) & F.col("failed").isNull())
        # A template's columns share one number of values, as in the reference; a slot is used once a variable fills it.
        slots = {}
        for k, n in enumerate(names):
            f = self._field(cohort, n)
            if encoder_of(f, cohort.model) == "Drain3Encoder":
                size = max(f.params.get("max_clusters", f.params.get("most", 200)), f.params.get("n_hash_features", 2000))
                slots |= {c: size for c in categories if c == f"n{k}" or c.startswith(f"n{k}_v")}
        return autoencoder.scored(rows, ["key"], ORDER, categories, [c for _, _, c, _ in numbers], "learns", "seq", autoencoder.Options(**given), keep=["phase"], slots=slots, before=before, finish=finish)

    def _by_network(self, out: DataFrame, rows: DataFrame, names: dict[str, str], features: list[Feature], explain: bool) -> DataFrame:
        """What _cohort gives, from what _networks says of rows."""
        shown = F.create_map(F.lit("buffer_size"), "buffered", F.lit("events_since_retrain"), F.coalesce("events_since_retrain", F.lit(0)))
        told = F.lit(None).cast(TOLD)
        if explain:
            # Only what is scored is shown.
            shown_rows = rows.filter("phase = 1").select(F.col("seq").alias("_seq"), self._shown(names, features, F.lit(True)).alias("_shown"))
            out = out.filter("phase = 1").join(shown_rows, F.col("seq") == F.col("_seq")).drop("_seq")
            own = {c: f.field for f in features for c in f.columns}
            field = lambda x: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in own.items() for v in kv]), x), x)
            parts = F.transform("parts", lambda x: F.struct(field(x["field"]).alias("field"), x["delta"].alias("delta")))
            share = lambda f: F.aggregate(F.filter(parts, lambda x: x["field"] == f), F.lit(0.0), lambda s, x: s + x["delta"])
            each = F.transform(F.array_distinct(F.transform(parts, lambda x: x["field"])), lambda f: F.struct(f.alias("field"), F.round(share(f), 4).alias("delta")))
            by_size = lambda a, b: F.when(F.abs(a["delta"]) > F.abs(b["delta"]), -1).when(F.abs(a["delta"]) < F.abs(b["delta"]), 1).otherwise(0)
            told = self._told(explain, F.col("_shown"), F.lit(0.0), F.array_sort(each, by_size))
        return out.filter("phase = 1").select("seq", "key", F.col("score").alias("anomaly_score"), F.col("error").alias("failed"), shown.alias("properties"), told.alias("explanation"))

    def _forests(self, cohort: Cohort, numbers: list[tuple[str, str, str, tuple[float, float] | None]]) -> tuple[list[trees.Forest], int]:
        """The trees of each slice, and the window."""
        window, count, slices = cohort.params.get("window_size", 250), cohort.params.get("n_trees", 25), cohort.params.get("sliding_steps", 1)
        if not 1 <= slices <= window:
            raise ValueError(f"sliding_steps {slices} is not between 1 and {window}")
        # An encoder without limits is drawn, and held, between -1 and 1.
        limits = [limit or (-1.0, 1.0) for *_, limit in numbers]
        return [trees.grow([n for _, n, *_ in numbers], limits, count, cohort.params.get("height") or trees.default_height(window), k) for k in range(slices)], window

    def _vectors(self, rows: DataFrame, numbers: list, forests: list[trees.Forest] | None = None) -> DataFrame:
        """rows with features, and failed where one is outside its limits."""
        rows = rows.withColumn("features", F.array(*[F.col(c).cast("double") for _, _, c, _ in numbers]))
        bounds = [(forests[0].names[i], *forests[0].limits[i]) for i in range(len(numbers))] if forests else [(n, *(limit or (None, None))) for _, n, _, limit in numbers]
        # A filter on failed must not be moved below the features: it would hold all that they are made of, many times over.
        stays = F.monotonically_increasing_id() >= 0
        return rows.withColumn("failed", F.when(stays, F.coalesce("failed", trees.bounds_error(F.col("features"), bounds))))

    def _by_extension(self, asked: DataFrame, state: DataFrame, cohort: Cohort, names: dict[str, str], features: list[Feature], explain: bool) -> DataFrame:
        """What _cohort gives, by a model from outside, which explains nothing."""
        told = self._told(explain, self._shown(names, features, F.lit(True)), F.lit(None), None)
        out = extensions.MODELS[cohort.model].score(asked.select("seq", "key", "features", "failed", told.alias("explanation")), state, cohort.params)
        score = F.when(F.col("failed").isNull(), F.col("anomaly_score").cast("double"))
        return out.select("seq", "key", score.alias("anomaly_score"), "failed", F.create_map().cast("map<string,long>").alias("properties"), "explanation")

    def _by_trees(self, asked: DataFrame, model: DataFrame, names: dict[str, str], features: list[Feature], numbers: list, forests: list[trees.Forest], window: int, explain: bool) -> DataFrame:
        """What _cohort gives, for rows with features and failed."""
        # A field is explained by all of its columns at once.
        groups = {f.field: [i for i, (_, _, c, _) in enumerate(numbers) if c in {x for g in features if g.field == f.field for x in g.columns}] for f in features}
        shown = [self._shown(names, features, F.lit(True)).alias("_shown")] if explain else []
        out = trees.scored(asked.select("seq", "key", "features", "failed", *shown), model, ["key"], "features", forests, window, explain, groups)
        said = self._told(explain, F.col("_shown"), F.col("explanation.baseline"), F.col("explanation.features")) if explain else F.lit(None).cast(TOLD)
        score = F.when(F.col("failed").isNull(), F.col("score"))
        return out.select("seq", "key", score.alias("anomaly_score"), "failed", F.when(F.col("reference_age").isNotNull(), F.create_map(F.lit("reference_age"), F.col("reference_age").cast("long"))).otherwise(F.create_map().cast("map<string,long>")).alias("properties"), said.alias("explanation"))

    def _both(self, ingest: DataFrame, score: DataFrame) -> tuple[DataFrame, dict[str, dict[str, str]]]:
        phase = lambda df, k: df.select(F.lit(k).alias("phase"), "seq", "payload")
        return self._extracted(phase(ingest, 0).unionByName(phase(score, 1)))

    def _once(self, rows: DataFrame) -> DataFrame:
        """Extracted rows with the key of each cohort (key_0, ...) and identifiers instead of the payload, written: each cohort reads
        them several times, and taking a payload apart costs more than all else that is done with a row."""
        rows = rows.withColumns({f"key_{i}": self._key(c) for i, c in enumerate(self.config.cohorts)} | {"identifiers": self._identifiers()}).drop("payload")
        path = scratch(rows.sparkSession, "extracted")
        rows.write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _error(self, upto: int | None = None) -> Column:
        """The first error of the cohorts, up to one of them."""
        errors = [F.col(f"error_{c.features}") for c in self.config.cohorts[:upto]]
        return F.coalesce(*errors, F.lit(None).cast("string"))

    def ingested(self, ingest: DataFrame, include_features: bool = False) -> DataFrame:
        """seq, accepted, error, identifiers (, cohorts: name and extracted fields) of each learned event."""
        rows, names = self._extracted(ingest.select("seq", "payload"))
        out = [F.col("seq"), self._error().isNull().alias("accepted"), self._error().alias("error"), self._identifiers().alias("identifiers")]
        if include_features:
            each = [F.struct(F.lit(c.name).alias("name"), F.array(*[F.struct(F.lit(n).alias("field"), F.col(x).cast("string").alias("value")) for n, x in names[c.features].items()]).alias("features")) for c in self.config.cohorts]
            out.append(F.when(self._error().isNull(), F.array(*each)).alias("cohorts"))
        return rows.select(*out)

    def learned(self, ingest: DataFrame) -> DataFrame:
        """seq, accepted, error, identifiers, cohorts of each learned event: what a service answers that is asked for features.

        cohorts: name, features (field, value, preprocessed, raw). Rows that a warm-up holds back have nothing preprocessed;
        an event that an encoder refuses is not accepted, and what none could tell is NULL.
        """
        rows, names = self._both(ingest, ingest.limit(0))
        parts = None
        for i, cohort in enumerate(self.config.cohorts):
            used = rows.filter(self._error(i + 1).isNull()).select(*ORDER, self._key(cohort).alias("key"), *names[cohort.features].values())
            used = used.withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy(*ORDER)))
            encoded, features, error = self._features(used, cohort, names[cohort.features])
            shown = self._shown(names[cohort.features], features, F.col("number") >= cohort.warmup)
            one = encoded.select("seq", F.lit(i).alias("at"), error.alias("failed"), F.struct(F.lit(cohort.name).alias("name"), shown.alias("features")).alias("cohort"))
            parts = one if parts is None else parts.unionByName(one)
        # As many rows for an event as there are cohorts.
        per = parts.groupBy("seq").agg(F.min_by("failed", F.when(F.col("failed").isNotNull(), F.col("at"))).alias("_failed"), F.collect_list(F.struct("at", "cohort")).alias("_rows"))
        asked = rows.select("seq", self._error().alias("_refused"), self._identifiers().alias("identifiers"))
        out = asked.join(per, "seq", "left").withColumn("error", F.coalesce("_refused", "_failed"))
        by_place = lambda a, b: a["at"] - b["at"]
        cohorts = F.transform(F.array_sort("_rows", by_place), lambda x: x["cohort"])
        return out.select("seq", F.col("error").isNull().alias("accepted"), "error", "identifiers", F.when(F.col("error").isNull(), cohorts).alias("cohorts"))

    def _identifiers(self) -> Column:
        found = paths.identifiers(F.col("payload"), list(self.config.identifiers)) if self.config.identifiers else F.lit(None)
        return found.cast("map<string,string>")

    def run(self, ingest: DataFrame, score: DataFrame, explain: bool = False) -> DataFrame:
        """seq, accepted, error, identifiers, composite_score, status, scores of each scored event.

        scores: name, key, weight, anomaly_score, score_label, properties, explanation of each cohort, in their order. If asked
        for, an explanation holds the event's fields, the largest share of the score first; without shares where the cohort's
        model gives none, as before its first window.
        """
        both, names = self._both(ingest, score)
        both = self._once(both)
        parts = refused = None
        for i, cohort in enumerate(self.config.cohorts):
            if refused is not None:
                both = both.join(refused, (F.col("seq") == F.col("_seq")) & (F.col("phase") == 0), "left_anti")
            # Learned: what no cohort up to this one refused. Scored: what none refused.
            taken = both.filter(F.when(F.col("phase") == 0, self._error(i + 1).isNull()).otherwise(self._error().isNull()))
            used = taken.select(*ORDER, F.col(f"key_{i}").alias("key"), *names[cohort.features].values())
            one = self._one_of(i, cohort, self._cohort(used, cohort, names[cohort.features], explain))
            parts = one if parts is None else parts.unionByName(one)
            refused = self._refused(used, cohort, names[cohort.features]) if i + 1 < len(self.config.cohorts) else None
        return self._answers(both.filter("phase = 1"), parts)

    def _refused(self, used: DataFrame, cohort: Cohort, names: dict[str, str]) -> DataFrame | None:
        """_seq of what a cohort refuses to learn, written, as each later cohort asks for it; None where it can refuse nothing.

        Only a vocabulary that is full, or a value outside the trees' limits, is refused; scaled values are within theirs.
        """
        encoders_ = {encoder_of(self._field(cohort, n), cohort.model) for n in names}
        if cohort.model != "HalfSpaceTrees" or not encoders_ & {"OneHotEncoder", "LabelIndex", "PassThrough", "MinMaxScaler"}:
            return None
        if cohort.warmup and cohort.fields and self.block is None:
            used = used.withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy(*ORDER)))
        rows, features, error = self._features(used.filter("phase = 0"), cohort, names)
        numbers = [(f.name, f"{f.name}__{i}", c, f.limits) for f in features for i, c in enumerate(f.columns)]
        rows = self._vectors(rows.withColumn("failed", error), numbers, self._forests(cohort, numbers)[0])
        path = scratch(used.sparkSession, "refused")
        rows.filter("failed is not null").select(F.col("seq").alias("_seq")).write.parquet(path)
        return used.sparkSession.read.schema("_seq long").parquet(path)

    def _key(self, cohort: Cohort) -> Column:
        return composite.cohort_key(cohort.name, [extract.text(paths.at(F.col("payload"), f)) for f in cohort.fields])

    @staticmethod
    def _one_of(at: int, cohort: Cohort, scored: DataFrame) -> DataFrame:
        return scored.select("seq", F.lit(at).alias("at"), F.lit(cohort.name).alias("name"), "key", F.lit(cohort.weight).alias("weight"), "anomaly_score", "failed", "properties", "explanation")

    def _answers(self, asked: DataFrame, parts: DataFrame) -> DataFrame:
        """The response to each extracted event, from what its cohorts say."""
        row = F.struct("at", "name", "key", "weight", F.when(F.col("failed").isNull(), F.col("anomaly_score")).alias("anomaly_score"), labels.label(F.col("anomaly_score")).alias("score_label"), "properties", "explanation")
        has = F.col("anomaly_score").isNotNull()
        # As many rows for an event as there are cohorts.
        per = parts.groupBy("seq").agg(
            F.collect_list(row).alias("_rows"), F.min_by("failed", F.when(F.col("failed").isNotNull(), F.col("at"))).alias("_failed"),
            (F.sum(F.when(has, F.col("weight") * F.col("anomaly_score"))) / F.sum(F.when(has, F.col("weight")))).alias("_s"),
        )
        asked = asked.select("seq", self._error().alias("_refused"), "identifiers")
        out = asked.join(per, "seq", "left").withColumn("error", F.coalesce("_refused", "_failed"))
        good = F.col("error").isNull()
        status = F.when(~good, None).when(F.col("_s").isNull(), "insufficient_data").otherwise(labels.label(F.col("_s")))
        # Maps have no order, so rows are put in order by their number.
        ordered = F.transform(F.array_sort(F.transform("_rows", lambda x: x["at"])), lambda at: F.get(F.filter("_rows", lambda x: x["at"] == at), F.lit(0)).dropFields("at"))
        return out.select("seq", good.alias("accepted"), "error", "identifiers", F.when(good, F.round("_s", 2)).alias("composite_score"), status.alias("status"), F.when(good, ordered).alias("scores"))
