"""Detections and difference regions: top-k, best match, validation.

A sample's boxes are gathered once, into one row with two ordered arrays; matching then runs inside the row, so no
pair of boxes is ever shuffled. The number of boxes of a sample is what a detector gives for an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import area, iou, overlap

BOX = ("x1", "y1", "x2", "y2")


def top_detections(boxes: DataFrame, k: int | None = 3) -> DataFrame:
    """The k best detections of a sample by score, equal scores in their order; adds rank."""
    ranked = boxes.withColumn("rank", F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("score"), "pos")).cast("long"))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def main_regions(boxes: DataFrame, ratio: float = 0.3) -> DataFrame:
    """Regions of at least ratio times the largest of their sample; adds area and rank, the largest first."""
    sized = boxes.withColumn("area", area(F.struct(*BOX)))
    kept = sized.withColumn("__most", F.max("area").over(Window.partitionBy("sample"))).filter(F.col("area") >= F.col("__most") * ratio)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("area"), "pos")).cast("long")).drop("__most")


def gathered(diffs: DataFrame, detections: DataFrame) -> DataFrame:
    """sample, diffs (largest area first) and detections (in order) as arrays; a side without boxes is empty."""
    box = F.struct("pos", *BOX)
    d = diffs.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct((-area(box)).alias("first"), "pos", *BOX))).alias("diffs"))
    s = detections.groupBy("sample").agg(F.sort_array(F.collect_list(box)).alias("detections"))
    none = F.array().cast("array<struct<pos:bigint,x1:bigint,y1:bigint,x2:bigint,y2:bigint>>")
    return d.join(s, "sample", "full").select("sample", F.coalesce(F.transform("diffs", lambda x: F.struct(*[x[c].cast("long").alias(c) for c in ("pos", *BOX)])), none).alias("diffs"), F.coalesce(F.transform("detections", lambda x: F.struct(*[x[c].cast("long").alias(c) for c in ("pos", *BOX)])), none).alias("detections"))


def _matched(samples: DataFrame) -> DataFrame:
    """Adds matches: for each difference its best detection by overlap ratio, the first of equals, none for ratio 0."""
    start = F.struct(F.lit(0.0).alias("iou"), F.lit(None).cast("long").alias("pos"), F.lit(0).cast("long").alias("area"))

    def best(d):
        def step(found, s):
            r = iou(d, s)
            return F.when(r > found["iou"], F.struct(r.alias("iou"), s["pos"].alias("pos"), area(s).cast("long").alias("area"))).otherwise(found)

        return F.aggregate("detections", start, step)

    return samples.withColumn("matches", F.transform("diffs", lambda d: F.struct(d.alias("box"), best(d).alias("best"))))


def best_matches(samples: DataFrame) -> DataFrame:
    """sample, pos, match_pos and iou of every difference; match_pos is null where nothing overlaps."""
    m = _matched(samples).select("sample", F.explode("matches").alias("m"))
    return m.select("sample", F.col("m.box.pos").alias("pos"), F.col("m.best.pos").alias("match_pos"), F.col("m.best.iou").alias("iou"))


def best_boxes(boxes: Column, least: float = 0.3, k: int | None = 3) -> Column:
    """Of an array of scored boxes the k best with a score of at least `least`, equal scores in their order; none for null."""
    placed = F.transform(F.coalesce(boxes, F.array()), lambda b, i: F.struct((-b["score"]).alias("first"), i.alias("at"), b.alias("box")))
    found = F.transform(F.array_sort(F.filter(placed, lambda x: -x["first"] >= least)), lambda x: x["box"])
    return found if k is None else F.slice(found, 1, k)


def with_verdict(samples: DataFrame, least_iou: float = 0.3, scale: float = 2.0) -> DataFrame:
    """Adds reason and kept (boxes). The first difference, in order, that breaks a rule decides alone."""

    def verdict(m):
        r, ratio = m["best"]["iou"], area(m["box"]).cast("double") / F.greatest(m["best"]["area"], F.lit(1))
        large = ratio > scale
        return F.when((r >= least_iou) & large, "scale_overflow_aligned").when(r >= least_iou, "keep").when((r > 0) & large, "background_collapse").otherwise("drop")

    df = _matched(samples).withColumn("verdicts", F.transform("matches", verdict))
    broken = F.filter("verdicts", lambda v: v.isin("scale_overflow_aligned", "background_collapse"))
    kept = F.transform(F.filter(F.arrays_zip("diffs", "verdicts"), lambda z: z["verdicts"] == "keep"), lambda z: z["diffs"])
    reason = F.when(F.size("diffs") == 0, "no_diff_regions").when(F.size("detections") == 0, "no_semantic_targets").when(F.size(broken) > 0, F.get(broken, F.lit(0))).when(F.size(kept) == 0, "no_valid_regions").otherwise("pass")
    df = df.withColumn("reason", reason)
    return df.withColumn("kept", F.when(F.col("reason") == "pass", kept).otherwise(F.slice(kept, 1, 0))).drop("matches", "verdicts")


def validated(samples: DataFrame, least_iou: float = 0.3, scale: float = 2.0) -> DataFrame:
    """sample, is_valid, reason and kept (boxes) of samples with diffs and detections."""
    return with_verdict(samples, least_iou, scale).select("sample", (F.col("reason") == "pass").alias("is_valid"), "reason", "kept")


def covered_components(components: DataFrame, boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """Components (sample, corners, area in pixels) that a kept box of their sample covers by more than least."""
    c, b = components.alias("c"), boxes.select("sample", *BOX).alias("b")
    common = overlap(F.struct(*[F.col(f"c.{x}") for x in BOX]), F.struct(*[F.col(f"b.{x}") for x in BOX]))
    return c.join(b, (F.col("c.sample") == F.col("b.sample")) & (common > F.col("c.area") * least), "left_semi")


def reason_counts(results: DataFrame) -> DataFrame:
    """How many samples ended for each reason; valid ones are successes."""
    return results.groupBy(F.when(F.col("is_valid"), "success").otherwise(F.coalesce("reason", F.lit("error"))).alias("reason")).agg(F.count("*").alias("n"))
