"""Scores to labels and percentiles to scores."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the labels, and the corners of the percentile scale.
LABELS = ((30, "NORMAL"), (50, "SLIGHTLY_ELEVATED"), (70, "ELEVATED"), (85, "ANOMALOUS"))
TOP, NONE = "HIGHLY_ANOMALOUS", "INSUFFICIENT_DATA"
POSITIVE = ("ANOMALOUS", "HIGHLY_ANOMALOUS")
SCALE = ((0, 0), (80, 30), (90, 50), (95, 70), (99, 85), (100, 100))


def label(score: Column) -> Column:
    out = F.when(score.isNull(), NONE)
    for bound, name in LABELS:
        out = out.when(score < bound, name)
    return out.otherwise(TOP)


def scaled_percentile(p: Column) -> Column:
    """Piecewise linear between the corners of SCALE."""
    out = None
    for (x0, y0), (x1, y1) in zip(SCALE, SCALE[1:], strict=False):
        value = y0 + (p - x0) * ((y1 - y0) / (x1 - x0))
        out = F.when(p <= x1, value) if out is None else out.when(p <= x1, value)
    return out.otherwise(F.lit(100.0))


def share_below(sorted_values: Column, value: Column) -> Column:
    """100 * the share of an array strictly below value; NULL for an empty array."""
    return F.try_divide(F.size(F.filter(sorted_values, lambda x: x < value)) * F.lit(100.0), F.size(sorted_values))
