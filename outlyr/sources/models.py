"""Learned models at rest: a folder of Parquet tables, one for each kind of state, to which every step adds a version.

A version holds the keys that its step changed, and no other; the state of a key is its row of the highest version. The table
of keys is written last: what it does not name has not happened, so a step that dies leaves nothing behind that is read, and
its number is used again. Writing a version of keys that is there already is an error, so of two writers one fails. compact()
writes the present state of every key as a version from which readers start, and deletes what came before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of each kind of state: what tells its rows apart, and what they hold.
KINDS = {
    "keys": ("cohort string, key string", "events long, trained long"),
    "moments": ("cohort string, key string, field string", "n long, mean double, std double, low double, high double"),
    "values": ("cohort string, key string, field string, value string", "id int, n long"),
    "masses": ("cohort string, key string, slice long, window long", "sums array<double>, counts array<long>, mass array<array<int>>"),
    "axes": ("cohort string, key string, field string", "axes array<array<double>>"),
    "sequences": ("cohort string, key string, field string", "state binary"),
    "own": ("cohort string, key string, field string", "state map<string,double>"),
    "waiting": ("cohort string, key string, step long, seq long", "json string"),
    "batches": ("stream string, batch long", "at timestamp"),
}
#: Kinds whose rows are no states of keys.
EVENTS = ("waiting", "batches")
#: Kinds that end a step.
LAST = "keys"


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


class ModelStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, *parts: str, prefix: str, done: bool = False) -> list[int]:
        place, files = self._files(*parts)
        if not files.exists(place):
            return []
        found = [s.getPath().getName() for s in files.listStatus(place)]
        numbers = [int(n.removeprefix(prefix)) for n in found if n.startswith(prefix)]
        return sorted(n for n in numbers if not done or self._exists(*parts, f"{prefix}{n}", "_SUCCESS"))

    def _exists(self, *parts: str) -> bool:
        place, files = self._files(*parts)
        return files.exists(place)

    def version(self) -> int:
        """The last step that ended; -1 before the first."""
        return max(self._numbers(LAST, prefix="version=", done=True), default=-1)

    def load(self, kind: str, cohort: str | None = None) -> DataFrame:
        """The present rows of a kind, without those of keys that were deleted."""
        own, held = KINDS[kind]
        last, first = self.version(), max(self._numbers(prefix="base-"), default=0)
        names = [n for n in self._numbers(kind, prefix="version=") if first <= n <= last]
        schema = f"{own}, {held}"
        if not names:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, version long").option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/version={n}" for n in names])
        if cohort is not None:
            rows = rows.filter(F.col("cohort") == cohort)
        if kind not in EVENTS and len(names) > 1:
            state = F.max_by(F.struct(*_names(held)), "version").alias("_s")
            rows = rows.groupBy(*_names(own)).agg(state).select(*_names(own), "_s.*")
        rows = rows.select(*_names(schema))
        return rows.filter("events is not null") if kind == LAST else rows

    def save(self, kind: str, rows: DataFrame, version: int) -> None:
        """Adds a step's rows; a step that is done again takes the place of what it left."""
        own, held = KINDS[kind]
        rows.select(*_names(f"{own}, {held}")).write.mode("error" if kind == LAST else "overwrite").parquet(f"{self.path}/{kind}/version={version}")

    def discard(self, version: int) -> None:
        """Deletes what a step of this number left that never ended."""
        for kind in KINDS:
            if kind != LAST or not self._exists(kind, f"version={version}", "_SUCCESS"):
                place, files = self._files(kind, f"version={version}")
                files.delete(place, True)

    def delete(self, keys: DataFrame) -> None:
        """Ends the models of keys (cohort, key); a key that comes again starts anew."""
        version = self.version() + 1
        self.discard(version)
        gone = keys.select("cohort", "key").distinct()
        for kind, (own, held) in KINDS.items():
            if kind not in (LAST, *EVENTS):
                rest = [F.lit(None).cast(part.split(" ", 1)[1]).alias(part.split()[0]) for part in held.split(", ")]
                self.save(kind, self.load(kind).join(gone, ["cohort", "key"], "left_semi").select(*_names(own), *rest), version)
        self.save(LAST, gone.select("*", F.lit(None).cast("long").alias("events"), F.lit(None).cast("long").alias("trained")), version)

    def has_batch(self, stream: str, batch: int) -> bool:
        """Whether a stream's micro-batch is in the models."""
        return not self.load("batches").filter((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty()

    def statistics(self) -> DataFrame:
        """cohort, key, events (that reached the model's encoders), trained (that its model learned)."""
        return self.load(LAST)

    def compact(self) -> int:
        """Writes the state of every key as one version, and deletes those before it, which no reader may be using."""
        version = self.version() + 1
        self.discard(version)
        known = self.load(LAST).select("cohort", "key")
        for kind, (_, held) in KINDS.items():
            if kind == LAST:
                continue
            rows = self.load(kind)
            if kind == "waiting":
                # These wait for a model that is not there yet; all others belong to one.
                rows = rows.join(known, ["cohort", "key"], "left_anti")
            elif kind not in EVENTS:
                alive = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in _names(held)])
                rows = rows.filter(alive).join(known, ["cohort", "key"], "left_semi")
            self.save(kind, rows, version)
        self.save(LAST, self.load(LAST), version)
        place, files = self._files(f"base-{version}")
        files.create(place, True).close()
        for kind in KINDS:
            for n in self._numbers(kind, prefix="version="):
                if n < version:
                    old, _ = self._files(kind, f"version={n}")
                    files.delete(old, True)
        return version
