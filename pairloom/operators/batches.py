"""Batches of one resolution, dealt to ranks; modes drawn for whole batches. Randomness is an MD5 of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import chunked, dense_index

#: Mask modes and their weights; fixed values.
MODES = (("shrink", 0.35), ("expand", 0.2), ("holes", 0.1), ("shift", 0.05), ("sam", 0.3))


def shuffled(seed: Column | str, *parts: Column) -> Column:
    """A sort key that shuffles: the MD5 of a seed and an id."""
    return F.md5(F.concat_ws("-", F.lit(seed) if isinstance(seed, str) else seed.cast("string"), *[p.cast("string") for p in parts]))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that only depends on its parts: eight hex digits of their MD5."""
    text = F.concat_ws("-", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def bucket_batches(res: DataFrame, size: int, seed: int = 0, drop_last: bool = True) -> DataFrame:
    """idx, width, height, chunk and place: shuffled inside each resolution, cut into batches.

    The shuffle key is uniform, so its first digits deal a resolution, however common, to many tasks.
    """
    key = shuffled(str(seed), F.col("idx"))
    slot = F.conv(F.substring(key, 1, 3), 16, 10).cast("int")
    return chunked(res, ["width", "height"], [key, F.col("idx")], size, drop_last, slot).select("idx", "width", "height", "chunk", "place")


def rank_batches(batches: DataFrame, replicas: int, seed: int = 0) -> DataFrame:
    """width, height, chunk, batch_no and rank: whole batches shuffled and dealt in turn; what doesn't go round is left out."""
    whole = batches.select("width", "height", "chunk").distinct()
    whole = whole.withColumn("__key", shuffled(str(seed), F.col("width"), F.col("height"), F.col("chunk")))
    numbered = dense_index(whole, "__key", "width", "height", "chunk", to="batch_no", total="__total").drop("__key")
    return numbered.filter(F.col("batch_no") < F.floor(F.col("__total") / replicas) * replicas).withColumn("rank", F.pmod(F.col("batch_no"), F.lit(replicas))).drop("__total")


def batches_per_rank(res: DataFrame, size: int, replicas: int) -> DataFrame:
    """n_floor and n_ceil: the batches of a rank without and with short ones."""
    counts = res.groupBy("width", "height").agg(F.count("*").alias("n"))
    per = lambda f: F.floor(F.sum(f(F.col("n") / size)) / replicas).cast("long")
    return counts.agg(per(F.floor).alias("n_floor"), per(F.ceil).alias("n_ceil"))


def batch_mode(u: Column, has_sam: Column) -> Column:
    """The mode of a batch from one uniform number; without a segment mask `sam` becomes `shrink`."""
    mode, bound = F.lit(MODES[-1][0]), 0.0
    pick = None
    for name, weight in MODES[:-1]:
        bound += weight
        test = u < F.lit(round(bound, 10))
        pick = F.when(test, name) if pick is None else pick.when(test, name)
    pick = pick.otherwise(mode)
    return F.when((pick == "sam") & ~has_sam, "shrink").otherwise(pick)
