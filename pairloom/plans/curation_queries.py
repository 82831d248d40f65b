"""The registered queries of the curation plan and of batch augmentation, on pictures made of the embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import augment as augment_operators
from ..operators import boxes as box_operators
from . import views
from .curation import Settings, curate
from .queries import query

#: Side of the pictures: 4 x 4 cells of 3 x 3 pixels.
SIDE, CELL = 12, 3
RANGES = augment_operators.Ranges(kernels=(1, 3, 5), times=(1, 2), holes=(1, 3), shift=3)
SETTINGS = Settings(weights=(1.0, 0.0, 0.0), disk=1, least_area=6, most_hole=3, most_main=1, main_ratio=0.6)


def curation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey pictures of which cells are bright after the edit, with boxes and object masks as models would leave them;
    some can't be loaded, some differ in size, some are cut short."""
    g = views.grids(spark, sf_dir)
    at = lambda row, col: F.get("v", (row * 8 + col).cast("int"))
    r, c = (lambda i: F.floor(i / SIDE)), (lambda i: i % SIDE)

    def changed(i: Column) -> Column:
        y, x = F.floor(r(i) / CELL) * 2, F.floor(c(i) / CELL) * 2
        return (at(y, x) + at(y, x + 1) + at(y + 1, x) + at(y + 1, x + 1)) / 4 > 0.03

    places = F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))
    bright = F.transform(places, changed)
    shot = F.unhex(F.array_join(F.transform(bright, lambda b: F.when(b, "F0F0F0").otherwise("3C3C3C")), ""))
    bg = F.unhex(F.repeat(F.lit("3C3C3C"), F.lit(SIDE * SIDE)))
    n = F.col("id")

    def box(k: Column) -> Column:
        x, y = (n * 7 + k * 5) % 8, (n * 3 + k * 4) % 8
        sides = (x, y, x + 3 + (n + k) % 5, y + 3 + (n * 2 + k) % 6)
        return F.struct(*[s.cast("int").alias(name) for s, name in zip(sides, box_operators.BOX, strict=True)], (((n * 13 + k * 7) % 10) / 10).cast("double").alias("score"))

    return g.select(
        n.alias("sample"),
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
        F.when(n % 19 == 0, SIDE + 1).otherwise(SIDE).alias("bg_height"),
        F.lit(SIDE).alias("bg_width"),
        F.when(n % 17 != 0, bg).alias("bg"),
        F.when(n % 23 == 0, F.substring(shot, 1, 30)).otherwise(shot).alias("shot"),
        F.when(n % 11 == 0, F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.lit(4)), box)).alias("boxes"),
        F.when(n % 5 != 0, F.transform(places, lambda i: ((r(i) + c(i) + n) % 3).cast("int"))).alias("objects"),
    )


@query
def curated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair's verdict, and the pixels of the masks of those that passed, counted and weighed by their places."""
    found = curate(curation_pairs(spark, sf_dir), SETTINGS)
    digits = F.split(F.hex("mask"), "(?<=\\G..)")
    places = F.filter(F.transform(F.slice(digits, 1, SIDE * SIDE), lambda x, i: F.when(x == "01", i.cast("long")).otherwise(F.lit(-1).cast("long"))), lambda p: p >= 0)
    known = F.when(F.col("is_valid"), places).otherwise(F.array().cast("array<bigint>"))
    return found.select("sample", "is_valid", "reason", F.size(known).cast("long").alias("area"), F.aggregate(known, F.lit(0).cast("long"), lambda a, p: a + p).alias("placed"))


@query
def curation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_operators.reason_counts(curate(curation_pairs(spark, sf_dir), SETTINGS))


@query
def augmented_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of batches of eight changed by their batch's mode: the mode, the pixels before and after, and their places.

    Where holes are drawn only the pixels before are told: their places come from a generator of NumPy's."""
    total = lambda m: F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + (x > 128).cast("long"))
    places = lambda m: F.aggregate(F.transform(m, lambda x, i: F.when(x > 128, i).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    mask = lambda at: F.transform("v", lambda x: F.when(x > at, 255).otherwise(0))
    g = views.grids(spark, sf_dir).select("id", F.expr("id div 8").alias("batch"), F.lit(8).alias("height"), F.lit(8).alias("width"), mask(0.0).alias("mask"), F.when(F.col("id") % 3 != 0, mask(0.1)).alias("sam_mask"))
    found = augment_operators.augment(g, 5, RANGES)
    told = lambda x: F.when(F.col("mode") == "holes", F.lit(-1).cast("long")).otherwise(x)
    return found.select("id", "mode", total(F.col("gt_mask")).alias("before"), told(total(F.col("mask"))).alias("after"), told(places(F.col("mask"))).alias("placed"))
