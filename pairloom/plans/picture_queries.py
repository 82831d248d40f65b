"""The registered queries of resizing, pasting and mask augmentation, over pictures made of the embeddings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..functions import raster
from ..functions.resample import paste_back, resize_pictures
from ..operators.batches import uniform
from . import views
from .queries import H, W, exploded, masks, query, rounded

INTS = ("array<int>", pa.list_(pa.int32()))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 values of each embedding as a picture of one of four shapes, and the size it is wanted in."""
    height = F.element_at(F.array(*[F.lit(h) for h in (8, 4, 16, 2)]), (F.col("id") % 4 + 1).cast("int"))
    g = views.grids(spark, sf_dir).withColumn("height", height).withColumn("width", F.expr("cast(64 div height as int)"))
    return g.withColumn("to_height", F.expr("cast(height div 2 + 3 as int)")).withColumn("to_width", F.expr("cast(width div 2 + 3 as int)"))


def _resized(spark: SparkSession, sf_dir: str, kernel: str) -> DataFrame:
    return exploded(resize_pictures(pictures(spark, sf_dir), "v", kernel), "resized", "x").select("id", "p", rounded(F.col("x")).alias("v"))


@query
def bicubic_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resized(spark, sf_dir, "bicubic")


@query
def lanczos_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resized(spark, sf_dir, "lanczos")


def colours(value: Column) -> Column:
    """Bytes of red, green and blue of a picture of values: |v|, 1 - |v| and v * v."""
    byte = lambda x: F.floor(F.least(x, F.lit(1.0)) * 255.0).cast("int")
    return F.flatten(F.transform(value, lambda v: F.array(byte(F.abs(v)), byte(1.0 - F.least(F.abs(v), F.lit(1.0))), byte(v * v))))


@query
def paste_back_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results made at another size, brought back and laid on the pictures by their weights."""
    p = pictures(spark, sf_dir).withColumn("picture", colours(F.col("v")))
    places = F.sequence(F.lit(0), F.col("to_height") * F.col("to_width") - 1)
    row, col = (lambda i: F.floor(i / F.col("to_width"))), (lambda i: i % F.col("to_width"))
    p = p.withColumn("alpha", F.transform(places, lambda i: F.floor((F.col("id") + 5 * row(i) + 3 * col(i)) % 5 * 255 / 4).cast("int")))
    shade = lambda i, k: ((F.col("id") * 31 + 7 * row(i) + 13 * col(i) + 50 * k) % 256).cast("int")
    p = p.withColumn("result", F.flatten(F.transform(places, lambda i: F.array(*[shade(i, k) for k in range(3)]))))
    found = paste_back(p.select("id", "height", "width", "to_height", "to_width", "picture", "result", "alpha"))
    return exploded(found, "pasted", "x").select("id", "p", F.col("x").cast("long").alias("v"))


# --- masks ----------------------------------------------------------------------------------------------------------


def nested_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of which every other one has a closed frame, so that what is set inside lies in a hole."""
    place = lambda i: (F.floor(i / W), i % W)

    def framed(v: Column, i: Column) -> Column:
        r, c = place(i)
        ring = F.least(r, c, H - 1 - r, W - 1 - c)
        return F.when(F.col("id") % 2 == 1, v > 0.07).when(ring == 0, True).when(ring == 1, False).otherwise(v > 0.07).cast("int")

    return views.grids(spark, sf_dir).select("id", F.transform("v", framed).alias("m"))


def _from_masks(df: DataFrame, f, *also: str) -> DataFrame:
    found = raster.map_grids(df, "m", H, W, lambda m, *x: f(m, *x).astype(int).ravel().tolist(), "e", *INTS, also=also)
    return exploded(found, "e", "v").select("id", "p", F.col("v").cast("long").alias("v"))


@query
def expand_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls of the outer components, grown once or twice by squares, some of them larger than the picture."""
    m = masks(spark, sf_dir).withColumn("kernel", F.element_at(F.array(F.lit(1), F.lit(3), F.lit(21)), (F.col("id") % 3 + 1).cast("int"))).withColumn("times", (F.col("id") % 2 + 1).cast("int"))
    return _from_masks(m, raster.hull_expanded, "kernel", "times")


@query
def outer_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many components a mask has, how many of them lie in no hole of another, and the pixels of their hulls."""

    def counts(m) -> dict:
        label, outer = raster.outer_components(m)
        return {"n_components": len(set(label[label >= 0].tolist())), "n_outer": len(outer), "hull_area": int(raster.hull_filled(m).sum())}

    kind = pa.struct([(n, pa.int64()) for n in ("n_components", "n_outer", "hull_area")])
    return raster.map_grids(nested_masks(spark, sf_dir), "m", H, W, counts, "x", "struct<n_components:bigint,n_outer:bigint,hull_area:bigint>", kind).select("id", "x.*")


@query
def random_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes at random pixels, some larger than the picture; undone where too little would stay."""
    m = masks(spark, sf_dir, 0.0).withColumn("kernel", F.element_at(F.array(F.lit(1), F.lit(3), F.lit(41)), (F.col("id") % 3 + 1).cast("int")))
    seeds = F.transform(F.sequence(F.lit(0), F.lit(W * H - 1)), lambda i: uniform("holes", F.col("id"), i) < 0.04)

    def holes(mask, seeds, kernel):
        import numpy as np

        return raster.holed(mask, np.array(seeds).reshape(H, W), kernel)

    return _from_masks(m.withColumn("seeds", seeds), holes, "seeds", "kernel")


@query
def shrink_chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks that lose the pixels nearest to their edge by chamfer distance, to a share drawn for each."""
    m = masks(spark, sf_dir, -0.1).withColumn("keep", 0.5 + 0.2 * uniform("shrink", F.col("id")))
    return _from_masks(m, raster.chamfer_shrunk, "keep")


@query
def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks whose holes of at most three pixels are filled."""
    return _from_masks(nested_masks(spark, sf_dir), lambda m: raster.without_holes(m, 3))


@query
def drop_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks without components of fewer than four pixels."""
    return _from_masks(masks(spark, sf_dir), lambda m: raster.without_small(m, 4))


@query
def core_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose effect (what a mask holds beyond the grown object) is large beside them."""
    g = views.grids(spark, sf_dir)
    both = g.select("id", px.binary(F.col("v"), 0.2).alias("o"), px.binary(F.col("v"), 0.0).alias("m"))
    grown = raster.map_grids(both, "o", H, W, lambda m: raster.expanded(m, 1.2).astype(int).ravel().tolist(), "e", *INTS)
    total = lambda c: px.total(c.cast("array<double>"))
    effect, own = total(F.zip_with("m", "e", lambda x, y: F.greatest(x - y, F.lit(0)))), total(F.col("e"))
    found = grown.select("id", "o", F.when(own > 0, effect / own).otherwise(0.0).alias("ratio")).filter("ratio > 0.15")
    return found.select("id", rounded(F.col("ratio")).alias("ratio"), total(F.col("o")).cast("long").alias("area"))
