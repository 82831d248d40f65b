"""Values derived by hand, published doctest values of text tables, and invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import cells, raster
from pairloom.functions import pixels as px
from pairloom.functions.boxes import iou
from pairloom.operators.order import dense_index, positional_join, worker_shares


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def box(*v):
    return F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)])


def test_iou(spark):
    got = one(spark, a=iou(box(0, 0, 2, 2), box(1, 1, 3, 3)), b=iou(box(0, 0, 1, 1), box(2, 2, 3, 3)), c=iou(box(1, 1, 1, 1), box(2, 2, 2, 2)))
    assert got.a == pytest.approx(1 / 7) and got.b == 0 and got.c == 0


def test_sizes(spark):
    got = one(spark, up=px.up_to_multiple(F.lit(1023)), cap=px.capped_size(F.lit(2048), F.lit(1000)), low=px.capped_size(F.lit(1023), F.lit(5)))
    assert got.up == 1024 and tuple(got.cap) == (1024, 496) and tuple(got.low) == (1008, 16)
    with pytest.raises(Exception, match="positive"):
        one(spark, bad=px.capped_size(F.lit(0), F.lit(5)))


THOUSANDS = {".": False, "1": True, "1.": True, ".1": True, "1000": False, "1,000": True, "1,0000": False, "1,000.1234": True, "+1,000.1234": True, "-1,000.1234": True}
NUMBERS = {"123.45": True, "123": True, "123e45": True, "inf": True, "spam": False, "123e45678": False}
TYPES = {None: "none", "": "none", "foo": "str", "1": "int", "\x1b[31m42\x1b[0m": "int", "1.5": "float", "True": "bool", "1,000": "int", "1,000.5": "float"}
DECIMALS = {"123.45": 2, "1001": -1, "eggs": -1, "123e45": 2, "123,456.78": 2}


def test_cells(spark):
    for table, f in ((THOUSANDS, cells.is_thousands), (NUMBERS, cells.is_number), (DECIMALS, cells.decimals), (TYPES, lambda c: cells.type_name(cells.type_rank(c)))):
        df = spark.createDataFrame([(k,) for k in table], "cell string")
        assert {r[0]: r[1] for r in df.select("cell", f(F.col("cell"))).collect()} == table


@pytest.mark.parametrize("values,want", [(["True", "False"], "bool"), (["1", "2"], "int"), (["1", "2.3"], "float"), (["1", "2.3", "four"], "str"), ([None, "brux"], "str"), (["1", "2", None], "int"), ([None, ""], "bool")])
def test_column_type(spark, values, want):
    df = spark.createDataFrame([("c", v) for v in values], "column string, cell string")
    assert cells.column_types(df).first().type == want


def test_dense_index_and_shares(spark):
    df = spark.range(103).select(F.format_string("%03d", F.pmod(F.col("id") * 37, F.lit(103))).alias("stem"))
    got = worker_shares(df, "stem", 8).orderBy("stem").collect()
    assert [r.idx for r in got] == list(range(103))
    sizes = [sum(r.worker == w for r in got) for w in range(8)]
    assert sizes == [13] * 7 + [12] and [r.worker for r in got] == sorted(r.worker for r in got)
    assert sorted(r.worker for r in worker_shares(df.limit(3), "stem", 8).collect()) == [0, 1, 2]
    assert dense_index(df.limit(0), "stem").count() == 0
    with pytest.raises(ValueError):
        positional_join(df, df.limit(5).withColumnRenamed("stem", "other"), "stem", "other", strict=True)


masks = st.lists(st.lists(st.integers(0, 1), min_size=7, max_size=7), min_size=1, max_size=7).map(np.array)


@settings(max_examples=60, deadline=None)
@given(masks)
def test_raster_invariants(m):
    on = m > 0
    grown, less = raster.expanded(m, 1.5), raster.shrunk(m, 0.6)
    assert (grown | on == grown).all() and (less & on == less).all()
    if 0 < on.sum() and not on.all():
        assert grown.sum() >= min(on.size, int(on.sum() * 1.5))
        want = np.array([[min((r - a) ** 2 + (c - b) ** 2 for a, b in np.argwhere(on)) for c in range(m.shape[1])] for r in range(m.shape[0])])
        assert (raster.square_distance(m) == want).all()
    label = raster.labelled(m)
    assert ((label >= 0) == on).all()
    for r, c in np.argwhere(on):
        near = label[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2]
        assert set(near[near >= 0]) == {label[r, c]}
    hull = raster.hull_filled(m)
    assert (hull | on == hull).all()
    assert (raster.without_holes(m, 99) | on == raster.without_holes(m, 99)).all()


def test_cleaning_and_heat():
    a = np.full((40, 40, 3), 90, np.uint8)
    b = a.copy()
    b[5:30, 5:30] = 230
    heat = raster.difference_heat(a, b)
    assert heat[15, 15] > 0.07 > heat[38, 38]
    mask = raster.cleaned(heat > 0.07, 2, 50, 20)
    assert mask[15, 15] and not mask[38, 38]
    assert (raster.difference_heat(a, a) == 0).all()
    assert raster.resized(a, 10, 20).shape == (10, 20, 3)
    white = raster.lab_of(np.full((1, 1, 3), 255, np.uint8))[0, 0]
    assert white[0] == pytest.approx(100, abs=0.01) and abs(white[1]) < 0.1
    assert raster.soft_edge(np.array([[1, 0, 0]]), 2).tolist() == [[1.0, 0.5, 0.0]]
