"""Picture resizing by separable kernels: a matrix of weights for each axis, and two products for all pictures of a size.

A target pixel's centre lies at (i + 0.5) * scale in the source. Its weights are the kernel's values at the distances of
the source pixels' centres from there, divided by their sum, so borders need no padding. Where a picture shrinks, the
kernel is widened by the scale, so that every source pixel has a say.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StructField, StructType


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    near, far = ((a + 2) * x - (a + 3)) * x * x + 1, ((x - 5) * x + 8) * x * a - 4 * a
    return np.where(x < 1, near, np.where(x < 2, far, 0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


#: Each kernel's function and how far it reaches.
KERNELS = {"bilinear": (_triangle, 1), "bicubic": (_cubic, 2), "lanczos": (_lanczos, 3)}


#: Keeps sums that are halves but for their last bits from being rounded down.
HAIR = 1e-9


@lru_cache(maxsize=256)
def weights(before: int, after: int, kernel: str) -> np.ndarray:
    """The matrix (after, before) that resizes one axis."""
    f, reach = KERNELS[kernel]
    scale = before / after
    wide = max(scale, 1.0)
    centre = (np.arange(after) + 0.5) * scale
    low = np.maximum(0, np.floor(centre - reach * wide + 0.5))
    high = np.minimum(before, np.floor(centre + reach * wide + 0.5))
    x = np.arange(before)[None, :]
    w = np.where((x >= low[:, None]) & (x < high[:, None]), f((x + 0.5 - centre[:, None]) / wide), 0.0)
    w /= w.sum(1, keepdims=True)
    w.flags.writeable = False
    return w


def resized(pictures: np.ndarray, height: int, width: int, kernel: str, as_bytes: bool = False) -> np.ndarray:
    """Pictures (n, h, w) or (n, h, w, channels) in another size.

    as_bytes: each pass is rounded (half up) and clipped to 0..255, as 8-bit pictures are resized.
    """
    flat = pictures.ndim == 3
    x = (pictures[..., None] if flat else pictures).astype(float)

    def settle(y: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(y + 0.5 + HAIR), 0, 255) if as_bytes else y

    if x.shape[2] != width:
        x = settle(np.einsum("ow,nhwc->nhoc", weights(x.shape[2], width, kernel), x, optimize=True))
    if x.shape[1] != height:
        x = settle(np.einsum("oh,nhwc->nowc", weights(x.shape[1], height, kernel), x, optimize=True))
    return x[..., 0] if flat else x


def by_size(sizes: Sequence[Sequence[int]]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Each different size and the rows that have it."""
    table = np.array(sizes, np.int64).reshape(len(sizes), -1)
    kinds, which = np.unique(table, axis=0, return_inverse=True)
    which = which.reshape(-1)
    order = np.argsort(which, kind="stable")
    for kind, rows in zip(kinds.tolist(), np.split(order, np.cumsum(np.bincount(which, minlength=len(kinds)))[:-1]), strict=True):
        yield tuple(kind), rows


def resize_pictures(df: DataFrame, column: str, kernel: str, to: str = "resized", channels: int = 1, as_bytes: bool = False) -> DataFrame:
    """Adds the pictures of a column in another size; null where the picture is null or a size is not positive.

    Rows have height, width (of the picture, an array in row order) and to_height, to_width. Pictures of one size in a
    batch are resized together.
    """
    sides = ["height", "width", "to_height", "to_width"]
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c != to])
    value = IntegerType() if as_bytes else DoubleType()
    fits = F.col(column).isNotNull()
    for s in sides:
        fits = fits & (F.coalesce(F.col(s), F.lit(0)) > 0)
    rows = rows.withColumn(column, F.when(fits & (F.size(column) == F.col("height") * F.col("width") * channels), F.col(column)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            there = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            at = np.array(lists.offsets)
            flat = lists.values.to_numpy(zero_copy_only=False)
            sizes = np.stack([batch.column(s).to_numpy(zero_copy_only=False)[there] for s in sides], 1).astype(np.int64) if len(there) else np.zeros((0, 4), np.int64)
            out: list = [None] * batch.num_rows
            for (h, w, th, tw), rows in by_size(sizes) if len(there) else ():
                stack = np.stack([flat[at[k] : at[k + 1]] for k in there[rows]]).reshape(-1, h, w, channels)
                found = resized(stack, th, tw, kernel, as_bytes).reshape(len(rows), -1)
                for k, x in zip(there[rows].tolist(), found, strict=True):
                    out[k] = x.astype(np.int32) if as_bytes else x
            kind = pa.list_(pa.int32() if as_bytes else pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, to])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField(to, ArrayType(value))]))


def composited(over: np.ndarray, under: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """`over` laid on `under` by 8-bit weights, rounded as 8-bit pictures are."""
    a = alpha.astype(np.int64)
    return ((over * a + under * (255 - a)) * 2 + 255) // 510


def paste_back(df: DataFrame, kernel: str = "bicubic", to: str = "pasted") -> DataFrame:
    """Adds results, made at to_height x to_width, pasted back on the pictures (height x width) they were made from.

    Rows have picture (height x width x 3 bytes), result (to_height x to_width x 3) and alpha (to_height x to_width, 0
    to 255). The result is brought to the picture's size by `kernel`, the weights by bilinear resizing; where they are 0
    the picture stays as it was. Null where one of the three is null.
    """
    columns = [("picture", 3), ("result", 3), ("alpha", 1)]
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c != to])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(c) for c, _ in columns}
            whole = np.logical_and.reduce([x.is_valid().to_numpy(zero_copy_only=False) for x in lists.values()])
            there, out = np.flatnonzero(whole), [None] * batch.num_rows
            sizes = [[batch.column(s)[k].as_py() for s in ("height", "width", "to_height", "to_width")] for k in there.tolist()]
            for (h, w, th, tw), own in by_size(sizes) if len(there) else ():
                stack = {c: np.stack([lists[c][k].values.to_numpy(zero_copy_only=False) for k in there[own].tolist()]).astype(np.int64) for c, _ in columns}
                under = stack["picture"].reshape(-1, h, w, 3)
                over = resized(stack["result"].reshape(-1, th, tw, 3), h, w, kernel, True).astype(np.int64)
                alpha = resized(stack["alpha"].reshape(-1, th, tw), h, w, "bilinear", True).astype(np.int64)[..., None]
                for k, x in zip(there[own].tolist(), composited(over, under, alpha).reshape(len(own), -1), strict=True):
                    out[k] = x.astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, to])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField(to, DataType.fromDDL("array<int>"))]))
