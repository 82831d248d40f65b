"""Box arithmetic as column expressions: corners x1, y1, x2, y2, no pixel added."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def overlap(a: Column, b: Column) -> Column:
    """The common area; 0 where a side of it isn't positive."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Common area over united area; 0 for an empty union."""
    common = overlap(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common.cast("double") / union).otherwise(F.lit(0.0))
