"""Typed extraction of configured fields from VARIANT payloads, as Column expressions in a few projections.

Every handler gives, for one field, its values by name and one error text (NULL if none). A missing path gives neither. An
event's error is that of its first failing field, in the order of the configuration.

What several expressions need (a value, its type, a parsed JSON text) is bound to a column of its own, in the projection of
the level at which it can be known: a payload's values first, then what is parsed from them, then the values inside. All
fields share the projections of a level, so a JSON text is parsed once for each row however often it is used, and a plan's
size follows the number of fields, not the depth to which they are nested.
"""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlyr.config import Field
from outlyr.functions import paths

#: Extended ISO date, with an optional time, fraction and offset; other forms are errors.
ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
SEMVER = r"^(\d+)(?:\.(\d+)(?:\.(\d+))?)?"
IPV4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
# Private and reserved IPv4 networks, as first address and prefix length.
PRIVATE_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.170", 31),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4), ("255.255.255.255", 32),
)


@dataclass
class Levels:
    """The projections of a compilation: columns by level, each made of columns of lower levels."""

    prefix: str
    columns: list[dict[str, Column]] = field(default_factory=list)

    def bind(self, made: Column, level: int) -> Column:
        while len(self.columns) <= level:
            self.columns.append({})
        name = f"{self.prefix}{level}_{len(self.columns[level])}"
        self.columns[level][name] = made
        return F.col(name)


@dataclass
class Binder:
    """One field's turn: what it binds is one level above what it bound before."""

    levels: Levels
    level: int

    def __call__(self, made: Column) -> Column:
        bound = self.levels.bind(made, self.level)
        self.level += 1
        return bound


@dataclass(frozen=True)
class Value:
    """What an expansion or an entry made: VARIANT, for later sources; level is where it can be read."""

    column: Column
    level: int


Handled = tuple[dict[str, Column], Column]


def _python_name(s: Column) -> Column:
    """The Python name of a type that schema_of_variant gives."""
    return (
        F.when(s == "VOID", "NoneType").when(s == "BOOLEAN", "bool").when(s == "STRING", "str").when(s == "BIGINT", "int")
        .when((s == "DOUBLE") | s.startswith("DECIMAL"), "float").when(s.startswith("ARRAY"), "list").otherwise("dict")
    )


def type_name(v: Column) -> Column:
    """The Python name of a JSON value's type."""
    return _python_name(F.schema_of_variant(v))


def text(v: Column, schema: Column | None = None) -> Column:
    """A JSON value as text: True and False, None for null, whole floats with .0; lists and objects as JSON."""
    s, plain = F.schema_of_variant(v) if schema is None else schema, v.cast("string")
    number = F.when(plain.rlike(r"^-?\d+$"), F.concat(plain, F.lit(".0"))).otherwise(plain)
    return F.when(v.isNull(), F.lit(None)).when(s == "VOID", "None").when(s == "BOOLEAN", F.initcap(plain)).when((s == "DOUBLE") | s.startswith("DECIMAL"), number).otherwise(plain)


def numeric(key: str, v: Column, bind: Binder) -> Handled:
    kind = bind(type_name(v))
    ok = kind.isin("int", "float")
    error = F.when(v.isNotNull() & ~ok, F.concat(F.lit(f"{key}: expected int or float, got "), kind))
    return {key: F.when(ok, F.try_variant_get(v, "$", "double"))}, error


def boolean(key: str, v: Column, bind: Binder) -> Handled:
    kind = bind(type_name(v))
    error = F.when(v.isNotNull() & (kind != "bool"), F.concat(F.lit(f"{key}: expected bool, got "), kind))
    return {key: F.when(kind == "bool", F.try_variant_get(v, "$", "boolean").cast("double"))}, error


def string(key: str, v: Column, bind: Binder) -> Handled:
    return {key: text(v, bind(F.schema_of_variant(v)))}, F.lit(None).cast("string")


def _string(key: str, v: Column, bind: Binder) -> tuple[Column, Column]:
    """The text of a string value, and the error of any other."""
    kind = bind(type_name(v))
    s = bind(F.when(kind == "str", F.try_variant_get(v, "$", "string")))
    return s, F.when(v.isNotNull() & (kind != "str"), F.concat(F.lit(f"{key}: expected str, got "), kind))


def _unreadable(key: str, s: Column, ok: Column, what: str) -> Column:
    return F.when(s.isNotNull() & ~F.coalesce(ok, F.lit(False)), F.concat(F.lit(f"{key}: cannot parse '"), s, F.lit(f"' as {what}")))


def timestamp(key: str, v: Column, bind: Binder) -> Handled:
    """Wall-clock hour, weekday (Monday 0) and weekend, whatever the offset."""
    s, error = _string(key, v, bind)
    part = lambda i: F.regexp_extract(s, ISO, i)
    number = lambda i: F.when(part(i) == "", "0").otherwise(part(i)).cast("int")
    parts = bind(F.when(s.rlike(ISO), F.struct(F.try_to_date(part(1)).alias("day"), number(2).alias("hour"), number(3).alias("minute"), number(4).alias("second"))))
    ok = bind(F.coalesce(parts["day"].isNotNull() & (parts["hour"] < 24) & (parts["minute"] < 60) & (parts["second"] < 60), F.lit(False)))
    weekday = F.when(ok, F.weekday(parts["day"]).cast("double"))
    found = {f"{key}.hour": F.when(ok, parts["hour"].cast("double")), f"{key}.dayofweek": weekday, f"{key}.is_weekend": F.when(ok, (weekday >= 5).cast("double"))}
    return found, F.coalesce(error, _unreadable(key, s, ok, "datetime"))


def _address(octets: Column) -> Column:
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value * 256 + F.get(octets, F.lit(i)).cast("long")
    return value


def _private(address: Column) -> Column:
    inside = F.lit(False)
    for first, bits in PRIVATE_V4:
        low = sum(int(x) << 8 * (3 - i) for i, x in enumerate(first.split(".")))
        inside = inside | address.between(low, low + (1 << 32 - bits) - 1)
    return inside


def ip_address(key: str, v: Column, bind: Binder) -> Handled:
    """Version 4 natively; version 6, which needs canonical forms, by a vectorised function over distinct texts of a batch."""
    s, error = _string(key, v, bind)
    octets = bind(F.when(s.rlike(IPV4), F.split(s, r"\.")))
    address = bind(_address(octets))
    six = bind(_ipv6(F.when(octets.isNull(), s)))
    share = F.conv(F.substring(F.sha2(six["network"], 256), 1, 8), 16, 10).cast("double") / 0xFFFFFFFF
    found = {f"{key}.is_private": F.when(octets.isNotNull(), _private(address).cast("double")).otherwise(six["private"].cast("double"))}
    found |= {f"{key}.o{i + 1}": F.get(octets, F.lit(i)).cast("double") for i in range(4)}
    return found | {f"{key}.subnet_hash": share}, F.coalesce(error, _unreadable(key, s, octets.isNotNull() | six["network"].isNotNull(), "IP address"))


def _ipv6(s: Column) -> Column:
    import pandas as pd

    @F.pandas_udf("network string, private boolean")
    def look(texts: pd.Series) -> pd.DataFrame:
        import ipaddress

        def one(t):
            if t is None:
                return None, None
            try:
                a = ipaddress.IPv6Address(t)
                return str(ipaddress.IPv6Network((a, 48), strict=False)), a.is_private
            except ValueError:
                return None, None

        known = {t: one(t) for t in texts.dropna().unique()}
        return pd.DataFrame([known.get(t, (None, None)) for t in texts], columns=["network", "private"])

    return look(s)


def semver(key: str, v: Column, bind: Binder) -> Handled:
    s, error = _string(key, v, bind)
    part = lambda i: F.regexp_extract(F.trim(s), SEMVER, i)
    parts = bind(F.when(F.trim(s).rlike(SEMVER), F.array(*[part(i) for i in (1, 2, 3)])))
    number = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit("")).cast("double")
    return {f"{key}.{n}": number(i) for i, n in enumerate(("major", "minor", "patch"))}, F.coalesce(error, _unreadable(key, s, parts.isNotNull(), "semver"))


def json_expand(key: str, v: Column, bind: Binder, leaves: list[str]) -> tuple[dict[str, Value], Column]:
    """The leaves (paths below key) that a configuration names, of an object in a JSON text; they have no type of their own."""
    s, error = _string(key, v, bind)
    parsed = bind(F.try_parse_json(s))
    kind = bind(type_name(parsed))
    inside = bind(F.when(kind == "dict", parsed))
    error = F.coalesce(error, _unreadable(key, s, parsed.isNotNull(), "JSON"), F.when(parsed.isNotNull() & (kind != "dict"), F.concat(F.lit(f"{key}: expected JSON object, got "), kind)))
    found = {}
    for leaf in leaves:
        # An object inside is no leaf: its own leaves are.
        value = bind.levels.bind(paths.at(inside, leaf), bind.level)
        found[f"{key}.{leaf}"] = Value(F.when(type_name(value) != "dict", value), bind.level + 1)
    return found, error


HANDLERS: dict[str, Callable[[str, Column, Binder], Handled]] = {"numeric": numeric, "boolean": boolean, "timestamp": timestamp, "ip_address": ip_address, "semver": semver} | {k: string for k in ("str_categorical", "str_identifier", "str_text")}


@dataclass(frozen=True)
class Compiled:
    """values by name and the event's error, over the columns that the levels add one after another."""

    levels: tuple[dict[str, Column], ...]
    values: dict[str, Column]
    error: Column


def compile_fields(payload: Column, fields: dict[str, Field], prefix: str = "_x") -> Compiled:
    """The values of all fields by name, and the event's error.

    In the order of the configuration: a source is a path of the payload, or what an earlier entry or expansion made; an
    entry that names an expanded value handles it again; ignore, or an unknown type, drops it.
    """
    levels = Levels(prefix)
    found: dict[str, Column] = {}
    made: dict[str, list[Value]] = {}
    errors: list[Column] = []
    for name, f in fields.items():
        source = f.source or name
        # The payload's own value comes first, then what was made last.
        earlier = made.get(source, [])[::-1]
        bind = Binder(levels, max([0, *(x.level for x in earlier)]))
        v = bind(F.coalesce(paths.at(payload, source), *[x.column for x in earlier]))
        made.setdefault(name, []).append(Value(v, bind.level))
        if f.type == "json_expand":
            wanted = [(other.source or n)[len(name) + 1 :] for n, other in fields.items() if (other.source or n).startswith(f"{name}.")]
            leaves, error = json_expand(name, v, bind, list(dict.fromkeys(wanted)))
            for k, value in leaves.items():
                made.setdefault(k, []).append(value)
        elif f.type in HANDLERS:
            values, error = HANDLERS[f.type](name, v, bind)
            for k, value in values.items():
                if k != name:
                    own = bind.levels.bind(value, bind.level)
                    made.setdefault(k, []).append(Value(F.when(own.isNotNull(), F.try_variant_get(F.to_variant_object(F.struct(own.alias("x"))), "$.x", "variant")), bind.level + 1))
                    value = own
                found[k] = value
        else:
            found.pop(name, None)
            continue
        errors.append(error)
    return Compiled(tuple(levels.columns), found, F.coalesce(*errors, F.lit(None).cast("string")))


def projected(events: DataFrame, compiled: list[Compiled]) -> DataFrame:
    """events with the columns of all levels; compilations must differ in their prefixes."""
    for k in range(max((len(c.levels) for c in compiled), default=0)):
        events = events.withColumns({n: x for c in compiled if k < len(c.levels) for n, x in c.levels[k].items()})
    return events


def extracted(events: DataFrame, fields: dict[str, Field], payload: str = "payload") -> DataFrame:
    """events with features (a struct of all values), accepted and error."""
    made = compile_fields(F.col(payload), fields)
    columns = [x.alias(n) for n, x in made.values.items()] or [F.lit(None).alias("none")]
    out = projected(events, [made]).select(*[F.col(f"`{c}`") for c in events.columns], F.struct(*columns).alias("features"), made.error.alias("error"))
    return out.withColumn("accepted", F.col("error").isNull())
