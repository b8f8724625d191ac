"""File sources: CSV, ARFF, NPZ and JSON step files. All read through Spark, so any store that it reaches will do."""

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as strings."""
    return spark.read.csv(path, header=True, sep=sep, encoding=encoding)


def arff(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A relation: numeric attributes as doubles, others as strings; '?' is NULL; comments and rows of a wrong length are left out.

    The header is the lines up to @data, read by the driver; rows are parsed by Spark. at is the row's line order.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("%"))
    head = [r.line for r in lines.filter(F.lower("line").startswith("@attribute")).collect()]
    attributes = [_attribute(x) for x in head]
    # Commas inside single or double quotes do not part values.
    values = F.split(F.col("line"), r""",(?=(?:[^']*'[^']*')*[^']*$)(?=(?:[^"]*"[^"]*")*[^"]*$)""")
    rows = lines.filter(~F.col("line").startswith("@")).select(F.monotonically_increasing_id().alias("at"), values.alias("v")).filter(F.size("v") == len(attributes))
    if limit is not None:
        rows = rows.orderBy("at").limit(limit)
    out = []
    for i, (name, is_number) in enumerate(attributes):
        v = F.btrim(F.get("v", F.lit(i)), F.lit(" '\""))
        v = F.when(v != "?", v)
        out.append((F.expr(f"try_cast(btrim(get(v, {i})) AS DOUBLE)") if is_number else v).alias(name))
    return rows.select("at", *out)


def _attribute(line: str) -> tuple[str, bool]:
    rest = line[len("@attribute") :].strip()
    if rest[0] in "'\"":
        end = rest.index(rest[0], 1)
        name, kind = rest[1:end], rest[end + 1 :]
    else:
        name, _, kind = rest.partition(" ") if " " in rest else rest.partition("\t")
    return name, kind.strip().lower() in ("numeric", "real", "integer")


def npz(spark: SparkSession, path: str, features: list[str] | None = None) -> DataFrame:
    """at, y and a double column for each feature of arrays X and y; no pickled objects are read. y must hold 0 and 1 alone."""
    binary = spark.read.format("binaryFile").load(path)
    width = binary.mapInPandas(lambda b: _npz_width(b), "n long").first()[0]
    names = features or [f"feature_{i}" for i in range(width)]
    kinds = "at long, y long, " + ", ".join(f"`{n}` double" for n in names)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    x, y = z["X"], z["y"].astype(np.int64)
                    if not np.isin(y, (0, 1)).all():
                        raise ValueError("y holds other values than 0 and 1")
                    for at in range(0, len(x), 10_000):
                        part = pd.DataFrame(x[at : at + 10_000].astype(np.float64), columns=names)
                        part.insert(0, "y", y[at : at + 10_000])
                        part.insert(0, "at", np.arange(at, at + len(part)))
                        yield part

    return binary.mapInPandas(rows, kinds)


def _npz_width(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            with np.load(io.BytesIO(content), allow_pickle=False) as z:
                yield pd.DataFrame({"n": [z["X"].shape[1]]})


def steps(spark: SparkSession, path: str) -> DataFrame:
    """A step file {"ingest": [...], "scores": [...]}: kind, seq (its place), payload (VARIANT)."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    parts = []
    for kind in ("ingest", "scores"):
        items = F.try_variant_get("v", f"$.{kind}", "array<variant>")
        parts.append(whole.select(F.lit(kind).alias("kind"), F.posexplode(items).alias("seq", "payload")))
    return parts[0].unionByName(parts[1])


#: What a predicate may hold besides literals: fields, comparisons, and, or, not.
_TOKEN = r"\s*(?:(?P<field>\.[A-Za-z_][\w.]*)|(?P<text>'(?:[^'\\]|\\.)*')|(?P<number>-?\d+(?:\.\d+)?)|(?P<op>==|!=|<=|>=|<|>|\(|\))|(?P<word>and|or|not)\b)"


def predicate(text: str, payload: Column | None = None) -> Column:
    """A condition such as ".class == 'attack' and .n > 3" as a Column; anything else is a ValueError, and nothing is evaluated."""
    import re

    sql, at = [], 0
    while at < len(text.rstrip()):
        m = re.compile(_TOKEN).match(text, at)
        if not m:
            raise ValueError(f"cannot read the predicate at {text[at:]!r}")
        at = m.end()
        kind, value = m.lastgroup, m[m.lastgroup]
        sql.append({"field": lambda v: "`" + v[1:] + "`", "op": lambda v: {"==": "=", "!=": "<>"}.get(v, v)}.get(kind, lambda v: v)(value))
    return F.expr(" ".join(sql))


def between(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows of [start, end) in time; the bounds reach the scan as filters."""
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end))


def date_math(text: str, now: Column) -> Column:
    """now, now-4w, now-1d/d and the like: a moment, moved by units and cut to the day, week, month or hour."""
    import re

    m = re.fullmatch(r"now(?:([+-])(\d+)([smhdwM]))?(?:/([hdwM]))?", text)
    if not m:
        raise ValueError(f"cannot read {text!r}")
    units = {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY", "w": "WEEK", "M": "MONTH"}
    out = now
    if m[1]:
        unit, n = units[m[3]], int(m[1] + m[2])
        out = out + F.expr(f"INTERVAL '{7 * n if unit == 'WEEK' else n}' {'DAY' if unit == 'WEEK' else unit}")
    return F.date_trunc(units[m[4]], out) if m[4] else out


def signins(spark: SparkSession, n: int | DataFrame, seed: int = 42, personas: int = 50, anomalies: float = 0.05) -> DataFrame:
    """Invented sign-in events: at, description and payload (JSON text); anomalies leave their persona's habits.

    n: how many, or a table whose id column gives one each.
    """
    pick = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(f"{seed}:{salt}")), F.lit(k)).cast("int")
    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(f"{seed}:{salt}")), F.lit(1_000_000)) / 1e6
    word = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i)
    countries, oses, browsers, departments = ("DE", "FR", "US", "GB", "IN"), ("Windows", "macOS", "Linux"), ("Chrome", "Firefox", "Safari"), ("eng", "sales", "hr", "ops")
    person = pick("person", personas)
    kind = F.when(unit("odd") < anomalies, word(("ANOMALY:country", "ANOMALY:latency", "ANOMALY:time", "ANOMALY:client"), pick("kind", 4))).otherwise("NORMAL")
    rows = (spark.range(n) if isinstance(n, int) else n).select("id", person.alias("p"), kind.alias("description"))
    habit = lambda values, step: word(values, F.pmod(F.col("p") * step, F.lit(len(values))).cast("int"))
    is_ = lambda k: F.col("description") == f"ANOMALY:{k}"
    hour = F.when(is_("time"), pick("h", 4)).otherwise(8 + pick("h", 10))
    when = F.timestamp_seconds(F.lit(1_767_225_600) + (F.col("id") * 600 / 86400).cast("long") * 86400 + hour * 3600 + pick("s", 3600))
    payload = F.struct(
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.struct(F.concat(F.lit("user"), F.col("p")).alias("id"), habit(departments, 1).alias("department")).alias("user"),
        F.struct(F.when(is_("country"), "KP").otherwise(habit(countries, 1)).alias("country_iso")).alias("ip"),
        F.struct(F.when(is_("client"), "BeOS").otherwise(habit(oses, 1)).alias("os"), habit(browsers, 1).alias("browser")).alias("client"),
        F.when(is_("latency"), 5000 + pick("l", 1000)).otherwise(80 + F.pmod("p", F.lit(40)) + pick("l", 20)).alias("latency"),
        F.col("description"),
    )
    return rows.select(F.col("id").alias("at"), "description", F.to_json(payload).alias("payload"))
