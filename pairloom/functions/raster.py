"""Pixel operations that need neighbours of neighbours, in NumPy, run over Arrow batches row by row."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def map_grids(df: DataFrame, column: str, height: int, width: int, f: Callable[..., object], to: str, kind: str, arrow: pa.DataType, also: Sequence[str] = ()) -> DataFrame:
    """df with a column `to`: f of each row's grid and of its columns `also`; null for null."""
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c != to])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            grids = batch.column(at)
            flat = grids.flatten().to_numpy(zero_copy_only=False).reshape(-1, height, width)
            grid = iter(flat)
            more = list(zip(*(batch.column(c).to_pylist() for c in also), strict=True)) if also else [()] * batch.num_rows
            out = [f(next(grid), *x) if there else None for there, x in zip(grids.is_valid().to_pylist(), more, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, to])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField(to, DataType.fromDDL(kind))]))


def moved(mask: np.ndarray, dr: int, dc: int, fill) -> np.ndarray:
    """A picture moved by rows and columns; a move beyond its sides leaves nothing of it."""
    out = np.full_like(mask, fill)
    h, w = mask.shape
    if abs(dr) < h and abs(dc) < w:
        out[max(0, dr) : h + min(0, dr), max(0, dc) : w + min(0, dc)] = mask[max(0, -dr) : h + min(0, -dr), max(0, -dc) : w + min(0, -dc)]
    return out


def widened(mask: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Set where a set pixel is at most `reach` places away along an axis: differences of running sums."""
    n = mask.shape[axis]
    sums = np.concatenate([np.zeros_like(mask.take([0], axis), dtype=np.int32), np.cumsum(mask, axis, dtype=np.int32)], axis)
    at = np.arange(n)
    return sums.take(np.minimum(at + reach + 1, n), axis) > sums.take(np.maximum(at - reach, 0), axis)


def box_dilated(mask: np.ndarray, kernel: int, times: int = 1) -> np.ndarray:
    """Dilated `times` times by a square of odd side; squares add up, so all times are one pass for each axis."""
    reach = kernel // 2 * times
    return widened(widened(mask > 0, reach, 0), reach, 1)


def disk_dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    """Dilated by a disk, one pass for each of its rows."""
    out = np.zeros(mask.shape, bool)
    for dr in range(radius + 1):
        wide = widened(mask, math.isqrt(radius * radius - dr * dr), 1)
        out |= moved(wide, dr, 0, False)
        out |= moved(wide, -dr, 0, False)
    return out


def disk_eroded(mask: np.ndarray, radius: int) -> np.ndarray:
    """Eroded by a disk; what lies outside the picture has no say."""
    return ~disk_dilated(~mask, radius)


def opened_closed(mask: np.ndarray, radius: int = 3) -> np.ndarray:
    """Opening, then closing, with a disk; what lies outside the picture has no say."""
    mask = disk_dilated(disk_eroded(mask > 0, radius), radius)
    return disk_eroded(disk_dilated(mask, radius), radius)


EIGHT = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
FOUR = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]


def _least_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0 .. n - 1 that each is joined with by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        low, new = np.minimum(x, y), label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def labelled(mask: np.ndarray, offsets: list[tuple[int, int]] = EIGHT) -> np.ndarray:
    """Each set pixel gets the smallest place (in row order) of its component, others -1.

    Components are made of the runs of rows: those that touch in neighbouring rows are joined.
    """
    h, w = mask.shape
    # columns of unset pixels on both sides keep the runs of a row from the next row's
    flat = np.pad(mask > 0, ((0, 0), (1, 1))).ravel().astype(np.int8)
    wide, slack = w + 2, int(len(offsets) > 5)
    edge = np.diff(flat, prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(end, start + wide - slack, "right")
    last = np.searchsorted(start, end + wide + slack, "left")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(start)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    root = start[_least_joined(len(start), a, b)]
    out = np.full(h * wide, -1)
    out[np.repeat(start, end - start) + np.arange((end - start).sum()) - np.repeat(np.cumsum(end - start) - (end - start), end - start)] = np.repeat(root // wide * w + root % wide - 1, end - start)
    return out.reshape(h, wide)[:, 1:-1]


def component_rows(mask: np.ndarray) -> list[dict]:
    """label, area and half-open bounds of the components, in order of their labels."""
    label = labelled(mask)
    r, c = np.nonzero(label >= 0)
    ids, own, area = np.unique(label[r, c], return_inverse=True, return_counts=True)
    low, high = np.full((2, len(ids)), label.size), np.zeros((2, len(ids)), np.int64)
    for k, at in enumerate((c, r)):
        np.minimum.at(low[k], own, at)
        np.maximum.at(high[k], own, at + 1)
    names = ("label", "area", "x1", "y1", "x2", "y2")
    return [dict(zip(names, row, strict=True)) for row in zip(ids.tolist(), area.tolist(), *low.tolist(), *high.tolist(), strict=True)]


COMPONENT = pa.list_(pa.struct([(n, pa.int64()) for n in ("label", "area", "x1", "y1", "x2", "y2")]))
COMPONENT_DDL = "array<struct<label:bigint,area:bigint,x1:bigint,y1:bigint,x2:bigint,y2:bigint>>"


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    label = labelled(mask)
    ids, n = np.unique(label[label >= 0], return_counts=True)
    return np.isin(label, ids[n >= least])


def without_holes(mask: np.ndarray, most: int) -> np.ndarray:
    """Holes (four-connected, not at the border) of at most `most` pixels are filled."""
    mask = mask > 0
    label = labelled(~mask, FOUR)
    edge = np.unique(np.concatenate([label[0], label[-1], label[:, 0], label[:, -1]]))
    ids, n = np.unique(label[label >= 0], return_counts=True)
    small = ids[(n <= most) & ~np.isin(ids, edge)]
    return mask | np.isin(label, small)


def cleaned(mask: np.ndarray, radius: int = 3, least: int = 2000, hole: int = 500) -> np.ndarray:
    return without_holes(without_small(opened_closed(mask, radius), least), hole)


def square_distance(mask: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of each pixel to the nearest set one, exactly: columns first, then rows."""
    h, w = mask.shape
    if not (mask > 0).any():
        return np.full((h, w), np.iinfo(np.int64).max)
    far = h + w
    place = np.where(mask > 0, 0, far).astype(np.int64)
    for r in range(1, h):
        place[r] = np.minimum(place[r], place[r - 1] + 1)
    for r in range(h - 2, -1, -1):
        place[r] = np.minimum(place[r], place[r + 1] + 1)
    across = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    square = np.where(place >= far, np.iinfo(np.int64).max // 4, place**2)
    return np.stack([(across + row[None, :]).min(1) for row in square])


def expanded(mask: np.ndarray, ratio: float = 1.2) -> np.ndarray:
    """Grown to ratio times its pixels by distance; all pixels at the last distance come along."""
    mask = mask > 0
    n = int(mask.sum())
    more = int(n * ratio) - n
    if ratio <= 1 or not n or more <= 0:
        return mask
    d = square_distance(mask)
    outside = np.sort(d[~mask])
    if not len(outside):
        return mask
    return np.ones_like(mask) if more >= len(outside) else mask | (d <= outside[more - 1])


def shrunk(mask: np.ndarray, keep: float) -> np.ndarray:
    """Shrunk to about `keep` of its pixels: those nearest to the outside go, with all at the last distance.

    Distances are exact. Without an outside nothing is near it, and the mask stays.
    """
    mask = mask > 0
    n = int(mask.sum())
    less = n - int(n * keep)
    if less <= 0 or mask.all():
        return mask
    d = square_distance(~mask)
    return mask & (d > np.sort(d[mask])[less - 1])


#: What a step costs in the 5 x 5 chamfer distance, in 65,536ths: straight on, diagonally, like a knight; fixed values.
STRAIGHT, DIAGONAL, KNIGHT = 65536, 91750, 143976
#: The distance of pixels that no unset pixel can be reached from.
FAR = (1 << 31) - 1 >> 2


def chamfer_distance(mask: np.ndarray) -> np.ndarray:
    """How far each set pixel is from the nearest unset one in steps of the 5 x 5 chamfer, in 65,536ths.

    Two passes: downwards from the two rows above and the pixel on the left, then the same from the other end. The steps
    along a row are one running minimum.
    """
    h, w = mask.shape
    d = np.full((h + 4, w + 4), FAR, np.int64)
    d[2:-2, 2:-2] = np.where(mask > 0, FAR, 0)
    along = STRAIGHT * np.arange(w)
    for _ in range(2):
        for r in range(2, h + 2):
            near, far = d[r - 1], d[r - 2]
            row = np.minimum.reduce([
                d[r, 2:-2],
                near[2:-2] + STRAIGHT,
                np.minimum(near[1:-3], near[3:-1]) + DIAGONAL,
                np.minimum(np.minimum(near[:-4], near[4:]), np.minimum(far[1:-3], far[3:-1])) + KNIGHT,
            ])
            d[r, 2:-2] = np.minimum(np.minimum.accumulate(row - along) + along, FAR)
        d = d[::-1, ::-1]
    return d[2:-2, 2:-2]


def chamfer_shrunk(mask: np.ndarray, keep: float) -> np.ndarray:
    """Shrunk to about `keep` of its pixels by chamfer distance; all at the last distance go.

    A mask without an outside has one distance everywhere, so nothing of it stays.
    """
    mask = mask > 0
    less = int(mask.sum()) - int(int(mask.sum()) * keep)
    if less <= 0:
        return mask
    d = chamfer_distance(mask)
    return d > np.partition(d[mask], less - 1)[less - 1]


def soft_edge(mask: np.ndarray, width: int = 8) -> np.ndarray:
    if not (mask > 0).any():
        return np.zeros(mask.shape)
    return np.where(mask > 0, 1.0, np.clip(1 - np.sqrt(square_distance(mask)) / max(1, width), 0, 1))


def outer_components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labels of a mask's pixels, and those of its components that no hole of another holds.

    Unset pixels are joined by four neighbours, so the border of a component is closed to them; a component lies outside
    of all holes if it touches the unset region around the picture.
    """
    room = np.pad(mask > 0, 1)
    ground = labelled(~room, FOUR)
    around = ground == ground[0, 0]
    beside = np.logical_or.reduce([moved(around, r, c, False) for r, c in FOUR[1:]])
    label = labelled(mask)
    return label, np.unique(label[beside[1:-1, 1:-1] & (label >= 0)])


def _turns(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The corners of one side of a convex hull, of points in order, without the last."""
    held: list[tuple[int, int]] = []
    for p in points:
        while len(held) > 1 and (held[-1][0] - held[-2][0]) * (p[1] - held[-2][1]) <= (held[-1][1] - held[-2][1]) * (p[0] - held[-2][0]):
            held.pop()
        held.append(p)
    return held[:-1]


def hull_filled(mask: np.ndarray) -> np.ndarray:
    """Each outer component filled to its convex hull: the pixels whose centres are in it or on its border.

    A hull is made of the first and last pixels of a component's rows and filled row by row, between the least and the
    greatest place where an edge meets the row.
    """
    h, w = mask.shape
    out = np.zeros(mask.shape, bool)
    label, outer = outer_components(mask)
    r, c = np.nonzero(np.isin(label, outer) & (label >= 0))
    own = np.searchsorted(outer, label[r, c])
    low, high = np.full((len(outer), h), w), np.full((len(outer), h), -1)
    np.minimum.at(low, (own, r), c)
    np.maximum.at(high, (own, r), c)
    for k in range(len(outer)):
        rows = np.flatnonzero(high[k] >= 0)
        points = sorted({(int(x), int(y)) for side in (low[k], high[k]) for x, y in zip(side[rows], rows, strict=True)})
        hull = _turns(points) + _turns(points[::-1]) or points
        first, last = np.full(h, w), np.full(h, -1)
        for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
            if ay == by:
                first[ay], last[ay] = min(first[ay], ax, bx), max(last[ay], ax, bx)
                continue
            (ax, ay), (bx, by) = sorted([(ax, ay), (bx, by)], key=lambda p: p[1])
            y = np.arange(ay, by + 1)
            up = (bx - ax) * (y - ay)
            first[y] = np.minimum(first[y], ax - (-up // (by - ay)))
            last[y] = np.maximum(last[y], ax + up // (by - ay))
        out |= (np.arange(w)[None, :] >= first[:, None]) & (np.arange(w)[None, :] <= last[:, None])
    return out


def hull_expanded(mask: np.ndarray, kernel: int, times: int) -> np.ndarray:
    """The hulls of the outer components, dilated `times` times by a square."""
    return box_dilated(hull_filled(mask), kernel, times)


def holed(mask: np.ndarray, seeds: np.ndarray, kernel: int, least: float = 0.4) -> np.ndarray:
    """Square holes at seeds; undone where less than `least` of the mask would stay."""
    mask = mask > 0
    out = mask & ~box_dilated(seeds, kernel)
    return mask if out.sum() < mask.sum() * least else out


def lab_of(rgb: np.ndarray) -> np.ndarray:
    """CIE L (0..100), a and b of 8-bit sRGB under D65, unrounded."""
    x = rgb.astype(float) / 255
    x = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
    xyz = x @ np.array([[0.412453, 0.212671, 0.019334], [0.357580, 0.715160, 0.119193], [0.180423, 0.072169, 0.950227]]) / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 216 / 24389, np.cbrt(xyz), xyz * (841 / 108) + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned, borders held."""
    h, w = image.shape[:2]
    y, x = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1), np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0).reshape(-1, 1, *[1] * (image.ndim - 2)), (x - x0).reshape(1, -1, *[1] * (image.ndim - 2))
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def difference_heat(bg: np.ndarray, shot: np.ndarray, weights: tuple[float, float, float] = (0.6, 0.3, 0.1), eps: float = 1e-6) -> np.ndarray:
    """How much two RGB pictures differ at each pixel, 0..1: log light, colour plane and texture."""

    def light(x: np.ndarray) -> np.ndarray:
        return ((x / 255.0) ** 2.2) @ np.array([0.299, 0.587, 0.114])

    def texture(x: np.ndarray) -> np.ndarray:
        g = np.pad(x @ np.array([0.299, 0.587, 0.114]), 1, mode="reflect")
        dx = g[:, 2:] - g[:, :-2]
        dy = g[2:] - g[:-2]
        return np.hypot(dx[:-2] + 2 * dx[1:-1] + dx[2:], dy[:, :-2] + 2 * dy[:, 1:-1] + dy[:, 2:])

    def unit(d: np.ndarray) -> np.ndarray:
        up = d[d > 0]
        return np.clip(d / (np.percentile(up, 99) + eps), 0, 1) if len(up) else np.zeros_like(d)

    a, b = bg.astype(float), shot.astype(float)
    parts = (np.abs(np.log(light(a) + 1e-3) - np.log(light(b) + 1e-3)), np.hypot(*np.moveaxis(lab_of(bg) - lab_of(shot), -1, 0)[1:]), np.abs(texture(a) - texture(b)))
    return np.clip(sum(w * unit(p) for w, p in zip(weights, parts, strict=True)), 0, 1)
