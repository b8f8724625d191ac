"""Paths into VARIANT payloads."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(part: str) -> str:
    return "['" + part.replace("'", "\\'") + "']"


def at(payload: Column, path: str, kind: str = "variant") -> Column:
    """The value of a dot path: a literal key of that name first, else step by step; NULL where missing.

    A JSON null that stands at the literal key wins over a nested value, as a VARIANT null is not NULL.
    """
    literal = F.try_variant_get(payload, "$" + _quoted(path), kind)
    return literal if "." not in path else F.coalesce(literal, nested(payload, path, kind))


def nested(payload: Column, path: str, kind: str = "variant") -> Column:
    """The value of a dot path, step by step only."""
    return F.try_variant_get(payload, "$" + "".join(map(_quoted, path.split("."))), kind)


def identifiers(payload: Column, paths: list[str]) -> Column:
    """MAP of the paths to their values as JSON text; NULL where missing."""
    pairs = [x for p in paths for x in (F.lit(p), nested(payload, p).cast("string"))]
    return F.create_map(*pairs)
