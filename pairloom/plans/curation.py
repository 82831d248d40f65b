"""The whole curation of pairs: difference, audit, detections, validation, segments, fusion - one row a sample.

What models found comes in columns: `boxes`, a detector's scored boxes on the edited picture, and `objects`, a
segmenter's mask of it. Nothing is shuffled: a sample's pictures are compared in one Arrow stage, Catalyst judges its
regions against the boxes, and a second stage fuses the masks of samples that passed. Every sample ends with a reason; a
row that raises ends with `error` and doesn't stop the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..functions import raster
from ..operators import boxes as box_operators


@dataclass(frozen=True)
class Settings:
    """Fixed values of the reproduction."""

    threshold: float = 0.07
    weights: tuple[float, float, float] = (0.6, 0.3, 0.1)
    disk: int = 3
    least_area: int = 2000
    most_hole: int = 500
    noise: float = 0.3
    most_main: int = 4
    main_ratio: float = 0.3
    detections: int = 3
    score: float = 0.3
    least_iou: float = 0.3
    scale: float = 2.0
    keep_overlap: float = 0.5
    expand: float = 1.2


REGION = ("x1", "y1", "x2", "y2", "area")
REGIONS = pa.list_(pa.struct([(k, pa.int64()) for k in REGION]))
FOUND_DDL = {"mask": "binary", "regions": f"array<struct<{','.join(f'{k}:bigint' for k in REGION)}>>", "reason": "string"}


def audit(found: list[dict], set_: Settings) -> str | None:
    """Why components (with areas) are no good; None if they are."""
    if not found:
        return "diff_quality_empty_mask"
    areas = [c["area"] for c in found]
    main = [a for a in areas if a >= max(areas) * set_.main_ratio]
    if len(main) > set_.most_main:
        return "diff_quality_too_many_objects"
    return "diff_quality_high_noise" if 1 - sum(main) / max(sum(areas), 1) > set_.noise else None


def _compared(bg: bytes | None, shot: bytes | None, before: tuple, shape: tuple, set_: Settings) -> tuple[bytes | None, list[dict], str | None]:
    """The cleaned mask of what differs, its main regions (the largest first) and what is wrong with them."""
    if bg is None or shot is None:
        return None, [], "image_load_error"
    if before != shape:
        return None, [], "shape_mismatch"
    try:
        a, b = (np.frombuffer(x, np.uint8).reshape(*shape, 3) for x in (bg, shot))
        mask = raster.cleaned(raster.difference_heat(a, b, set_.weights) > set_.threshold, set_.disk, set_.least_area, set_.most_hole)
        found = raster.component_rows(mask)
    except Exception:  # one bad picture is a counted reason, not a failed job
        return None, [], "error"
    most = max((c["area"] for c in found), default=0)
    regions = sorted((c for c in found if c["area"] >= most * set_.main_ratio), key=lambda c: -c["area"])
    return mask.astype(np.uint8).tobytes(), [{k: c[k] for k in REGION} for c in regions], audit(found, set_)


def differences(pairs: DataFrame, set_: Settings = Settings()) -> DataFrame:
    """Pairs with mask (a byte a pixel), regions and reason (null if good) in place of the pictures.

    pairs have height and width, bg_height and bg_width, and the pictures bg and shot as RGB bytes.
    """
    used = ["bg", "shot", "bg_height", "bg_width", "height", "width"]
    rest = [c for c in pairs.columns if c not in ("bg", "shot", "bg_height", "bg_width", *FOUND_DDL)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_compared(bg, shot, (h, w), (th, tw), set_) for bg, shot, h, w, th, tw in zip(*(batch.column(c).to_pylist() for c in used), strict=True)]
            masks, regions, reasons = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(masks, pa.binary()), pa.array(regions, REGIONS), pa.array(reasons, pa.string())], names=[*rest, *FOUND_DDL])

    schema = StructType([*(pairs.schema[c] for c in rest), *(StructField(c, DataType.fromDDL(d)) for c, d in FOUND_DDL.items())])
    return pairs.select(*rest, *[c for c in used if c not in rest]).mapInArrow(run, schema)


def _fused(mask: bytes, objects: list[int] | None, kept: list[dict], shape: tuple, set_: Settings) -> bytes:
    """The components that a kept box covers and the objects inside kept boxes, expanded."""
    label = raster.labelled(np.frombuffer(mask, np.uint8).reshape(shape))
    covered = []
    for c in raster.component_rows(label >= 0):
        sides = [(min(c["x2"], k["x2"]) - max(c["x1"], k["x1"]), min(c["y2"], k["y2"]) - max(c["y1"], k["y1"])) for k in kept]
        if any(w > 0 and h > 0 and w * h / c["area"] > set_.keep_overlap for w, h in sides):
            covered.append(c["label"])
    final = np.isin(label, covered) & (label >= 0)
    if objects is not None:
        seen = objects.reshape(shape) > 0
        for k in kept:
            final[k["y1"] : k["y2"], k["x1"] : k["x2"]] |= seen[k["y1"] : k["y2"], k["x1"] : k["x2"]]
    return raster.expanded(final, set_.expand).astype(np.uint8).tobytes()


def curate(pairs: DataFrame, set_: Settings = Settings()) -> DataFrame:
    """sample, is_valid, reason and mask (a byte a pixel, of the valid ones) of every pair.

    pairs: as for differences, with sample, boxes (array of x1, y1, x2, y2, score) and objects (array of a number a pixel,
    more than 0 on objects; null: none).
    """
    diff = differences(pairs, set_)
    place = lambda boxes: F.transform(boxes, lambda b, i: F.struct(i.cast("long").alias("pos"), *[b[c].cast("long").alias(c) for c in box_operators.BOX]))
    seen = diff.withColumnRenamed("reason", "__fault").withColumns({"diffs": place(F.col("regions")), "detections": place(box_operators.best_boxes(F.col("boxes"), set_.score, set_.detections))})
    judged = box_operators.with_verdict(seen, set_.least_iou, set_.scale)
    judged = judged.withColumn("reason", F.coalesce("__fault", "reason"))
    good = F.col("reason") == "pass"
    rows = judged.select("sample", good.alias("is_valid"), "reason", "height", "width", F.when(good, F.col("mask")).alias("mask"), F.when(good, F.col("objects").cast("array<int>")).alias("objects"), F.when(good, F.col("kept")).alias("kept"))

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            objects, out = batch.column("objects"), []
            for k, (mask, kept, h, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("mask", "kept", "height", "width")), strict=True)):
                own = objects[k].values.to_numpy(zero_copy_only=False) if objects[k].is_valid else None
                out.append(None if mask is None else _fused(mask, own, kept, (h, w), set_))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sample", "is_valid", "reason")), pa.array(out, pa.binary())], names=["sample", "is_valid", "reason", "mask"])

    schema = StructType([*(rows.schema[c] for c in ("sample", "is_valid", "reason")), StructField("mask", DataType.fromDDL("binary"))])
    return rows.mapInArrow(fuse, schema)
