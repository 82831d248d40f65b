"""Seeded mask augmentation: a mode for each batch, then shrink, hull growth, holes, shift or the segment mask."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import raster
from .batches import batch_mode, uniform


@dataclass(frozen=True)
class Ranges:
    """Fixed values of the two training set-ups."""

    keep: tuple[float, float] = (0.5, 0.7)
    kernels: tuple[int, ...] = (11, 17, 21)
    times: tuple[int, int] = (1, 3)
    holes: tuple[int, ...] = (21, 31, 41)
    hole_share: float = 0.0005
    shift: int = 50


WIDE = Ranges()
NARROW = Ranges(kernels=(7, 11, 17), holes=(17, 21, 31), shift=35)


def drawn(seed: int, what: str, key: Column) -> Column:
    """A uniform number for a row and a purpose."""
    return uniform(f"{seed}-{what}", key)


def _pick(values: tuple[int, ...], u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def with_draws(df: DataFrame, key: str, seed: int, ranges: Ranges) -> DataFrame:
    """Adds what the modes need: keep, kernel, times, hole, dx, dy and the seed of the holes, by seed and key alone."""
    u = lambda what: drawn(seed, what, F.col(key))
    between = lambda what, low, high: (F.floor(u(what) * (high - low + 1)) + low).cast("int")
    return df.withColumns({
        "__keep": ranges.keep[0] + (ranges.keep[1] - ranges.keep[0]) * u("keep"),
        "__kernel": _pick(ranges.kernels, u("kernel")),
        "__times": between("times", *ranges.times),
        "__hole": _pick(ranges.holes, u("hole")),
        "__dx": between("dx", -ranges.shift, ranges.shift),
        "__dy": between("dy", -ranges.shift, ranges.shift),
        "__holes": F.xxhash64(F.lit(seed), F.lit("holes"), F.col(key).cast("string")),
    })


DRAWS = ("__keep", "__kernel", "__times", "__hole", "__dx", "__dy", "__holes")


def augmented(mask: np.ndarray, mode: str, draws: dict, ranges: Ranges = WIDE) -> np.ndarray:
    """A mask of 0 and 255 changed by a mode; unknown modes only binarize."""
    m = mask > 128
    if mode == "shrink":
        m = raster.chamfer_shrunk(m, draws["__keep"])
    elif mode == "expand" and m.any():
        m = raster.hull_expanded(m, draws["__kernel"], draws["__times"])
    elif mode == "holes":
        seeds = np.random.default_rng(draws["__holes"] % (1 << 63)).random(m.shape) < ranges.hole_share
        m = raster.holed(m, seeds, draws["__hole"])
    elif mode == "shift":
        m = raster.moved(m, draws["__dy"], draws["__dx"], False)
    return m.astype(np.uint8) * 255


def augment(df: DataFrame, seed: int = 0, ranges: Ranges = WIDE) -> DataFrame:
    """Rows (batch, id, mask, height, width and perhaps sam_mask) with mode, gt_mask and the changed mask.

    Every row of a batch has its mode; a row without a segment mask shrinks where its batch takes them. A row that has
    gt_mask keeps it. A segment mask is taken as it is. A table without masks is returned as it is.
    """
    if "mask" not in df.columns:
        return df
    sam = F.col("sam_mask") if "sam_mask" in df.columns else F.lit(None)
    df = df.withColumn("mode", batch_mode(uniform(str(seed), F.col("batch")), sam.isNotNull()))
    df = df if "gt_mask" in df.columns else df.withColumn("gt_mask", F.col("mask"))
    rows = with_draws(df.withColumn("mask", F.when(F.col("mode") == "sam", sam).otherwise(F.col("mask")).cast("array<int>")), "id", seed, ranges)
    kept = [c for c in rows.columns if c not in DRAWS]

    def run(batches):
        for batch in batches:
            masks, out = batch.column("mask"), []
            columns = zip(*(batch.column(c).to_pylist() for c in ("mode", "height", "width", *DRAWS)), strict=True)
            for x, (mode, height, width, *draws) in zip(masks, columns, strict=True):
                if not x.is_valid or mode == "sam":
                    out.append(x.values if x.is_valid else None)
                else:
                    grid = x.values.to_numpy(zero_copy_only=False).reshape(height, width)
                    out.append(augmented(grid, mode, dict(zip(DRAWS, draws, strict=True)), ranges).astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())) if c == "mask" else batch.column(c) for c in kept], names=kept)

    return rows.mapInArrow(run, StructType([StructField(c, ArrayType(IntegerType()) if c == "mask" else rows.schema[c].dataType) for c in kept]))
