"""From edit triplets to ordered pairs, and joins of image lists by stem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import positional_join

DEFAULT_PROMPT = "edited region"
ADD, REMOVE = "Add object", "Remove object"
#: Extensions of images in the order in which they are preferred.
PREFERRED = (".png", ".jpg", ".jpeg", ".bmp")


def stem_of(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def suffix_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def stem_number(n: Column) -> Column:
    """At least six digits; longer numbers keep theirs."""
    return F.format_string("%06d", n)


def without_mask_prefix(stem: Column) -> Column:
    return F.regexp_replace(stem, "^mask_", "")


def shard_counts(edits: DataFrame) -> DataFrame:
    """shard, n_add, n_remove and the first id that each category of a shard takes; additions come first.

    Only shards are ordered in one task, never rows.
    """
    counts = edits.groupBy("shard").agg(F.count_if(F.col("category") == ADD).alias("n_add"), F.count_if(F.col("category") == REMOVE).alias("n_remove"))
    so_far = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    adds = F.sum("n_add").over(Window.partitionBy(F.lit(0)))
    return counts.select("shard", "n_add", "n_remove", (F.sum("n_add").over(so_far) - F.col("n_add")).alias("first_add"), (adds + F.sum("n_remove").over(so_far) - F.col("n_remove")).alias("first_remove"))


def ordered_pairs(edits: DataFrame, held_out: tuple[int, ...] = ()) -> DataFrame:
    """stem, category, bg, shot and prompt: the image without the object before the one with it, under dense ids."""
    used = edits.filter(~F.col("shard").isin(*held_out) if held_out else F.lit(True))
    counts = shard_counts(used)
    rows = used.filter(F.col("category").isin(ADD, REMOVE))
    adds = F.col("category") == ADD
    number = F.row_number().over(Window.partitionBy("shard", "category").orderBy("row")) - 1
    rows = rows.withColumn("__n", number).join(counts, "shard")
    ident = F.when(adds, F.col("first_add")).otherwise(F.col("first_remove")) + F.col("__n")
    return rows.select(
        stem_number(ident).alias("stem"),
        "category",
        F.when(adds, F.col("source")).otherwise(F.col("edited")).alias("bg"),
        F.when(adds, F.col("edited")).otherwise(F.col("source")).alias("shot"),
        F.col("instruction").alias("prompt"),
    )


def last_by_stem(images: DataFrame) -> DataFrame:
    """stem and path: of several files of one stem the last in path order counts."""
    return images.groupBy(stem_of(F.col("path")).alias("stem")).agg(F.max("path").alias("path"))


def pair_by_stem(bg: DataFrame, shot: DataFrame) -> DataFrame:
    """stem, bg_path and shot_path of stems that both sides have."""
    return last_by_stem(bg).withColumnRenamed("path", "bg_path").join(last_by_stem(shot).withColumnRenamed("path", "shot_path"), "stem")


def last_prompts(*parts: DataFrame) -> DataFrame:
    """stem and prompt of several lists (stem, prompt, seq): a later sequence number overrides."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("stem").agg(F.max_by("prompt", "seq").alias("prompt"))


def with_prompts(pairs: DataFrame, prompts: DataFrame, default: str = DEFAULT_PROMPT) -> DataFrame:
    return pairs.join(prompts, "stem", "left").withColumn("prompt", F.coalesce("prompt", F.lit(default)))


def pair_masks(images: DataFrame, masks: DataFrame, by: str = "count") -> tuple[DataFrame, DataFrame]:
    """Images (path) with masks (path): stem, image and mask, and the images that stay without one.

    by: "position" pairs both lists in path order (the shorter one ends it), "stem" by file name, without a job of its
    own. "count" is the original flow, which counts both lists first: by position if they are equally long or there is
    one image only, else by stem; lists of the same length but of different files are paired without a word.
    """
    if by not in ("position", "stem", "count"):
        raise ValueError(f"masks are paired by position, stem or count, not by {by}")
    a, b = images.select(F.col("path").alias("image")), masks.select(F.col("path").alias("mask"))
    if by == "count":
        n = images.count()
        by = "position" if n == 1 or n == masks.count() else "stem"
    if by == "position":
        pairs = positional_join(a, b, "image", "mask").select(stem_of(F.col("image")).alias("stem"), "image", "mask")
        return pairs, a.join(pairs.select("image"), "image", "left_anti")
    left, right = a.withColumn("stem", stem_of(F.col("image"))), last_by_stem(masks).withColumnRenamed("path", "mask")
    return left.join(right, "stem").select("stem", "image", "mask"), left.join(right, "stem", "left_anti").select("image")


def preferred_image(masks: DataFrame, images: DataFrame, order: tuple[str, ...] = PREFERRED) -> DataFrame:
    """stem, mask and image: for each mask_<stem> the image of the first extension that exists; masks without one go."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), suffix_of(F.col("path")))
    best = images.withColumn("__rank", rank).filter("__rank > 0").groupBy(stem_of(F.col("path")).alias("stem")).agg(F.min_by("path", "__rank").alias("image"))
    return masks.select(F.col("path").alias("mask"), without_mask_prefix(stem_of(F.col("path"))).alias("stem")).join(best, "stem").select("stem", "mask", "image")


def common_stems(bg: DataFrame, shot: DataFrame) -> DataFrame:
    return bg.select(stem_of(F.col("path")).alias("stem")).intersect(shot.select(stem_of(F.col("path")).alias("stem")))
