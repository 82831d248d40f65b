"""Morphology, labels, hulls, distances and resizing against plain versions."""

import heapq

import numpy as np
import pytest

from pairloom.functions import raster as R
from pairloom.functions.resample import KERNELS, composited, paste_back, resize_pictures, resized, weights

RNG = np.random.default_rng(0)


def masks(n, most=14):
    for _ in range(n):
        h, w = RNG.integers(1, most, 2)
        yield RNG.random((h, w)) < RNG.choice([0, 0.05, 0.3, 0.6, 0.95, 1.1])


def plain_labels(mask, steps):
    h, w = mask.shape
    out = np.full((h, w), -1)
    for r, c in np.argwhere(mask):
        todo = [(r, c)] if out[r, c] < 0 else []
        while todo:
            y, x = todo.pop()
            if 0 <= y < h and 0 <= x < w and mask[y, x] and out[y, x] < 0:
                out[y, x] = r * w + c
                todo += [(y + dy, x + dx) for dy, dx in steps]
    return out


def plain_hulls(mask):
    out, label = np.zeros(mask.shape, bool), plain_labels(mask, R.EIGHT)
    cross = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    for k in np.unique(label[label >= 0]):
        points = [(int(c), int(r)) for r, c in np.argwhere(label == k)]
        edges = [(a, b) for a in points for b in points if a != b and all(cross(a, b, p) >= 0 for p in points)]
        xs, ys = zip(*points, strict=True)
        for y in range(min(ys), max(ys) + 1):
            for x in range(min(xs), max(xs) + 1):
                out[y, x] |= all(cross(a, b, (x, y)) >= 0 for a, b in edges)
    return out


def plain_chamfer(mask):
    cost = {(0, 1): R.STRAIGHT, (1, 1): R.DIAGONAL, (1, 2): R.KNIGHT}
    steps = [(dr, dc, cost[k]) for dr in range(-2, 3) for dc in range(-2, 3) if (k := tuple(sorted((abs(dr), abs(dc))))) in cost]
    out = np.where(mask, R.FAR, 0)
    todo = [(0, r, c) for r, c in np.argwhere(~mask).tolist()]
    heapq.heapify(todo)
    while todo:
        d, r, c = heapq.heappop(todo)
        for dr, dc, k in steps:
            y, x = r + dr, c + dc
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and d + k < out[y, x]:
                out[y, x] = d + k
                heapq.heappush(todo, (d + k, y, x))
    return out


def test_moves_beyond_the_sides():
    m = np.ones((3, 5), bool)
    assert not R.moved(m, 3, 0, False).any() and not R.moved(m, 0, -7, False).any()
    assert R.moved(m, -2, 4, False).sum() == 1


def test_dilations():
    for m in masks(150):
        kernel, times, radius = int(RNG.choice([1, 3, 5, 11, 41])), int(RNG.integers(1, 4)), int(RNG.integers(0, 5))
        near = lambda r, c, reach: m[max(0, r - reach) : r + reach + 1, max(0, c - reach) : c + reach + 1].any()
        box = np.array([[near(r, c, kernel // 2 * times) for c in range(m.shape[1])] for r in range(m.shape[0])])
        assert (R.box_dilated(m, kernel, times) == box).all()
        disk = lambda x: np.array([[any((r - y) ** 2 + (c - z) ** 2 <= radius**2 for y, z in np.argwhere(x)) for c in range(m.shape[1])] for r in range(m.shape[0])])
        assert (R.disk_dilated(m, radius) == disk(m)).all() and (R.disk_eroded(m, radius) == ~disk(~m)).all()


def test_labels_and_components():
    for m in masks(200):
        for steps in (R.EIGHT, R.FOUR):
            label = plain_labels(m, steps)
            assert (R.labelled(m, steps) == label).all()
        label = plain_labels(m, R.EIGHT)
        for row in R.component_rows(m):
            r, c = np.nonzero(label == row["label"])
            assert (row["area"], row["x1"], row["y1"], row["x2"], row["y2"]) == (len(r), c.min(), r.min(), c.max() + 1, r.max() + 1)


def test_hulls():
    for m in masks(150, 9):
        assert (R.hull_filled(m) == plain_hulls(m)).all()


def test_islands_in_holes_are_no_outer_components():
    m = np.zeros((9, 9), bool)
    m[0], m[-1], m[:, 0], m[:, -1], m[4, 4] = True, True, True, True, True
    label, outer = R.outer_components(m)
    assert len(np.unique(label[label >= 0])) == 2 and outer.tolist() == [0]
    m[0, 4] = False  # the hole is open now
    assert len(R.outer_components(m)[1]) == 2


def test_chamfer_distance():
    for m in masks(150):
        assert (R.chamfer_distance(m) == plain_chamfer(m)).all()
    assert not R.chamfer_shrunk(np.ones((4, 4)), 0.5).any() and not R.chamfer_shrunk(np.zeros((4, 4)), 0.5).any()


def test_large_pictures_stay_linear():
    import time

    seeds = RNG.random((1024, 1024)) < 0.0005
    start = time.perf_counter()
    grown = R.box_dilated(seeds, 41, 3)
    R.hull_filled(R.box_dilated(seeds, 41))
    R.chamfer_distance(grown)
    R.opened_closed(grown)
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("kernel", sorted(KERNELS))
def test_weights(kernel):
    for before, after in ((8, 3), (3, 8), (1, 5), (5, 1), (64, 64), (7, 16)):
        w = weights(before, after, kernel)
        assert w.shape == (after, before) and np.allclose(w.sum(1), 1)
        assert np.allclose(resized(np.full((2, before, before), 7.0), after, after, kernel), 7)
    assert np.allclose(weights(64, 64, kernel), np.eye(64))


def test_mirrored_pictures_give_mirrored_results():
    x = RNG.random((3, 9, 14, 2))
    for kernel in KERNELS:
        assert np.allclose(resized(x, 4, 25, kernel)[:, ::-1, ::-1], resized(x[:, ::-1, ::-1], 4, 25, kernel))


def test_resize_edges(spark):
    rows = [(1, 2, 2, 3, 3, [1, 2, 3, 4]), (2, 2, 2, 0, 3, [1, 2, 3, 4]), (3, 2, 2, 3, 3, None), (4, 2, 3, 3, 3, [1, 2]), (5, None, 2, 1, 1, [1, 2]), (1, 2, 2, 3, 3, [1, 2, 3, 4])]
    df = spark.createDataFrame(rows, "id int, height int, width int, to_height int, to_width int, resized array<int>").withColumnRenamed("resized", "x")
    got = sorted((r.id, r.resized) for r in resize_pictures(df, "x", "bicubic", as_bytes=True).collect() if r.resized)
    assert [k for k, _ in got] == [1, 1] and len(got[0][1]) == 9 and got[0] == got[1]
    assert resize_pictures(df.limit(0), "x", "lanczos").count() == 0


def test_paste_back_keeps_what_has_no_weight(spark):
    rows = [(1, 1, 2, 1, 2, [1, 2, 3, 4, 5, 6], [100] * 6, [0, 255]), (2, 1, 2, 1, 2, None, [1] * 6, [0, 0])]
    df = spark.createDataFrame(rows, "id int, height int, width int, to_height int, to_width int, picture array<int>, result array<int>, alpha array<int>")
    assert [r.pasted for r in paste_back(df).orderBy("id").collect()] == [[1, 2, 3, 100, 100, 100], None]
    assert (composited(np.array([255]), np.array([0]), np.arange(256)) == np.arange(256)).all()
