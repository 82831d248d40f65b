"""Hard negatives against SQL on the tables and a plain version on the edges."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm.hard_negatives import LEAST, MOST, NEGATIVES_SQL, Planes, first_of_windows, mine, op13_hard_negatives, sifted, whole_vectors

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    """rows: (id, label, whole numbers), None where a row takes no part."""
    held = {}
    for i, label, q in rows:
        if i is not None and label is not None and q is not None:
            held[i] = min(held.get(i, (str(label), q)), (str(label), q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a in filter(is_anchor, held):
        label, q = held[a]
        scored = sorted((-dot(q, v), i, l) for i, (l, v) in held.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out |= {(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(fits, 1)}
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/{sf}/embeddings.parquet')")
    want = set(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({NEGATIVES_SQL})").fetchall())
    assert {tuple(r) for r in op13_hard_negatives(spark, f"/root/testdata/{sf}").select(COLUMNS).collect()} == want and want


def groups(n, width, spread, r):
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(k, k % 3, [x + r.gauss(0, spread) for x in centres[k % 6]]) for k in range(n)]


NAN, INF = float("nan"), float("inf")
EDGES = [(500, 1, [1.0, 2.0]), (500, 0, [1.0, 2.0]), (500, 1, [1.0, 2.0]), (501, None, [1.0]), (None, 1, [1.0]), (502, 1, None), (503, 1, [1.0, None]), (504, 1, [NAN]), (505, 1, [INF, 1.0]), (506, 2, []), (507, 1, [0.5]), (600, 1, []), (508, 0, [-0.001, 3.9])]


@pytest.mark.parametrize("spread,anchors,block", [(0.1, 16384, 8192), (2.0, 3, 11), (0.0, 7, 64)])
def test_against_plain(spark, spread, anchors, block):
    rows = groups(150, 7, spread, random.Random(2)) + EDGES
    whole = lambda v: None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, label int, embedding array<double>, rank int, q0 int").repartition(3)
    got = mine(df.select("vec_id", "label", whole_vectors("embedding").alias("q"), "rank"), F.col("vec_id") % 10 == 0, anchor_rows=anchors, block_rows=block)
    assert {tuple(r) for r in got.select(COLUMNS).collect()} == plain([(i, l, whole(v)) for i, l, v in rows], lambda i: i % 10 == 0)


@pytest.mark.parametrize("size", [1, 3, 256, 1 << 12, 1 << 24])
def test_planes_sift_exactly(size):
    r = np.random.default_rng(size)
    for _ in range(20):
        n, m, d, w, keep = (int(x) for x in r.integers(1, (60, 8, 9, 4, 6)))
        rows, anchors = r.integers(-size, size, (n, d)), r.integers(-size, size, (m, d))
        may = r.random((m, n)) < r.choice([0.05, 0.5, 1.0])
        score = anchors @ rows.T
        ends = np.sort(r.integers(score.min() - 1, score.max() + 2, (2, m, w)), axis=0)
        low, high = np.where(r.random((m, w)) < 0.3, LEAST, ends[0]), np.where(r.random((m, w)) < 0.3, MOST, ends[1])
        ids = r.permutation(n)
        i, j, found = sifted(Planes(rows), anchors, may, low, high, keep)
        assert (score[i, j] == found).all() and may[i, j].all()
        got = {tuple(int(x) for x in t) for t in zip(*first_of_windows(ids, i, j, found, low, high, keep), strict=True)}
        want = set()
        for a in range(m):
            for k in range(w):
                fits = sorted((-score[a, b], ids[b], b) for b in range(n) if may[a, b] and low[a, k] <= score[a, b] <= high[a, k])
                want |= {(a, k, int(b), int(-s)) for s, _, b in fits[:keep]}
        assert got == want


def test_candidates_are_dropped_early():
    """With one row far ahead, most pairs end before the last plane."""
    r = np.random.default_rng(0)
    rows, anchors = r.integers(-256, 256, (4000, 64)), r.integers(-256, 256, (40, 64))
    planes, seen = Planes(rows), []
    plane = planes.plane
    planes.plane = lambda s, at=slice(None): (x := plane(s, at), seen.append((s, len(x))))[0]
    sifted(planes, anchors, np.ones((40, 4000), bool), np.full((40, 1), LEAST), np.full((40, 1), MOST), 5)
    assert sum(n for s, n in seen if s == 0) < 40 * 4000 // 20


def test_scores_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(0, 1, [1 << 60, 1 << 60]), (1, 1, [1 << 60, 1])], "vec_id long, label int, q array<long>")
    with pytest.raises(Exception, match="64 bits"):
        mine(df, F.col("vec_id") == 0).collect()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, label int, q array<long>")
    assert mine(df, F.col("vec_id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1, 2])], "vec_id long, label int, q array<long>")
    assert mine(alone, F.col("vec_id") % 100 == 0).count() == 0
