"""Sources, sinks, slots, augmentation, the curation plan and the stream on small data."""

import json
import sqlite3
from collections import namedtuple
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.operators import augment, batches, metrics, pairs, slots
from pairloom.operators.boxes import best_boxes, validated
from pairloom.plans.curation import Settings, curate
from pairloom.sources import images, shards, sinks, tables
from pairloom.sources.headers import probe_folder
from pairloom.sources.picture_sink import write_pictures
from pairloom.streaming import arrivals


def test_shards(spark, tmp_path):
    for k in range(3):
        spark.range(4).select(F.lit("Add object").alias("category"), "id").coalesce(1).toPandas().to_parquet(f"{tmp_path}/{shards.shard_name(k, 3)}")
    df = shards.read_shards(spark, str(tmp_path), [1])
    assert {(r.shard, r.row) for r in df.collect()} == {(s, i) for s in (0, 2) for i in range(4)}
    assert shards.read_shard(spark, str(tmp_path), 2, 3).count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        shards.read_shard(spark, str(tmp_path), 9, 3)
    assert {r.n for r in shards.category_counts(spark, str(tmp_path)).collect()} == {4}


def test_images(spark, tmp_path):
    picture = np.zeros((4, 6, 3), np.uint8)
    picture[..., 0] = 200
    df = spark.createDataFrame([("000001", bytearray(images.png(picture))), ("000002", bytearray(b"no image"))], "stem string, data binary")
    write_pictures(sinks.image_names(df, "bg"), str(tmp_path))
    assert images.list_images(spark, str(tmp_path / "bg")).count() == images.glob_images(spark, str(tmp_path / "bg")).count() == 2
    got = images.read_images(spark, str(tmp_path / "bg"))
    assert {(r.width, r.height) for r in probe_folder(spark, str(tmp_path / "bg")).collect()} == {(6, 4), (512, 512)}
    r = got.filter("height > 0").first()
    assert (images.rgb(r.data, r.height, r.width, r.channels) == picture).all()
    assert images.gray(r.data, r.height, r.width, r.channels)[0, 0] == 60


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text(" a.png \n\n/b.png\n")
    assert [r.path for r in tables.read_manifest(spark, str(tmp_path / "m.txt"), "/root/x/").orderBy("line").collect()] == ["/root/x/a.png", "/b.png"]
    (tmp_path / "p.json").write_text(json.dumps({"000001": "é"}))
    assert [tuple(r) for r in tables.read_map(spark, str(tmp_path / "p.json")).collect()] == [("000001", "é")]
    assert tables.read_map(spark, str(tmp_path / "none.json")).count() == 0
    assert [r.parts for r in tables.read_delimited(spark, str(tmp_path / "m.txt")).collect()][-1] == ["/b.png"]
    sinks.write_map(spark.createDataFrame([("b", "2"), ("a", None)], "stem string, prompt string"), str(tmp_path / "map"))
    assert [r.value for r in spark.read.text(str(tmp_path / "map")).collect()] == ["{", '  "a": "",', '  "b": "2"', "}"]
    (tmp_path / "c.yaml").write_text("seed: 3\n")
    assert str(tables.read_config(str(tmp_path / "c.yaml"))["seed"]) == "3"
    spark.range(1).write.parquet(str(tmp_path / "cache"))
    assert tables.read_cache(spark, str(tmp_path / "cache")).count() == 1
    assert spark.range(1).select(tables.clean_key(F.lit("module.a.weight"))).first()[0] == "a.weight"


def test_ingest(spark):
    @dataclass
    class D:
        a: int
        b: str

    con = sqlite3.connect(":memory:")
    T = namedtuple("T", "a b")
    cursor = con.execute("SELECT 1 AS a, 'x' AS b")
    for data in ([[1, "x"]], {"a": [1], "b": ["x"]}, [{"a": 1, "b": "x"}], [T(1, "x")], [D(1, "x")], cursor):
        got = tables.ingest(spark, data, headers=["a", "b"])
        assert got.columns == ["a", "b"] and tuple(got.first()) == ("1", "x")
    assert tables.ingest(spark, [[1, 2]], headers=["b"]).columns == ["_0", "b"]
    assert tuple(tables.ingest(spark, {"a": [1, 2], "b": [3]}).collect()[1]) == ("2", None)
    assert tables.ingest(spark, [["h"], [5]], headers="firstrow").columns == ["h"]
    assert tables.ingest(spark, [{"a": 1}, {"b": 2}], headers={"a": "x"}).columns == ["x", "b"]


def test_checkpoints(spark, tmp_path):
    names = spark.createDataFrame([(f"checkpoint-{k}",) for k in (2, 9, 10)], "name string")
    assert [r.step for r in metrics.checkpoints_to_drop(names, 3).collect()] == [2]
    for step in (2, 9, 10, 11):
        sinks.save_checkpoint(spark.range(1), str(tmp_path / "ck"), step, 3)
    assert sorted(p.name for p in (tmp_path / "ck").iterdir()) == ["checkpoint-10", "checkpoint-11", "checkpoint-9"]
    assert sinks.latest_step(spark, str(tmp_path / "ck")) == 11
    log = spark.createDataFrame([(1, "loss", float("nan"))], "step long, metric string, value double")
    with pytest.raises(Exception, match="not finite"):
        metrics.checked_finite(log).collect()
    sinks.append_metrics(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_rank_batches(spark):
    res = spark.range(56).select(F.col("id").alias("idx"), F.lit(256).alias("width"), F.lit(256).alias("height"))
    dealt = batches.rank_batches(batches.bucket_batches(res, 8), 2).collect()
    assert sorted((r.batch_no, r["rank"]) for r in dealt) == [(k, k % 2) for k in range(6)]
    u = spark.range(20000).select(batches.batch_mode(batches.uniform("m", F.col("id")), F.lit(True)).alias("m")).groupBy("m").count()
    share = {r.m: r["count"] / 20000 for r in u.collect()}
    assert all(abs(share[m] - w) < 0.02 for m, w in batches.MODES)


BOX = "array<struct<pos:bigint,x1:bigint,y1:bigint,x2:bigint,y2:bigint>>"


@pytest.mark.parametrize(
    "diffs,found,reason,kept",
    [
        ([], [(1, 0, 0, 2, 2)], "no_diff_regions", 0),
        ([(1, 0, 0, 2, 2)], [], "no_semantic_targets", 0),
        ([(1, 0, 0, 4, 4)], [(1, 0, 0, 4, 4)], "pass", 1),
        ([(1, 0, 0, 4, 4), (2, 0, 0, 9, 3)], [(1, 0, 0, 4, 4), (2, 0, 0, 3, 3)], "pass", 2),
        ([(1, 0, 0, 4, 4)], [(1, 0, 0, 2, 3)], "scale_overflow_aligned", 0),
        ([(1, 0, 0, 4, 4), (2, 10, 10, 30, 30)], [(1, 0, 0, 4, 4), (2, 10, 10, 12, 12)], "background_collapse", 0),
        ([(1, 0, 0, 4, 4)], [(1, 8, 8, 9, 9)], "no_valid_regions", 0),
    ],
)
def test_validation(spark, diffs, found, reason, kept):
    r = validated(spark.createDataFrame([(1, diffs, found)], f"sample long, diffs {BOX}, detections {BOX}")).first()
    assert (r.reason, len(r.kept), r.is_valid) == (reason, kept, reason == "pass")


def test_pairs_edge_cases(spark):
    assert spark.range(1).select(pairs.stem_number(F.lit(1234567))).first()[0] == "1234567"
    a = spark.createDataFrame([("x/1.png",)], "path string")
    b = spark.createDataFrame([("y/7.png",)], "path string")
    assert pairs.pair_masks(a, b)[0].first().mask == "y/7.png"  # as many on both sides: by position
    c = spark.createDataFrame([("y/1.png",), ("y/2.png",), ("y/3.png",)], "path string")
    d = spark.createDataFrame([("x/1.png",), ("x/9.png",)], "path string")
    good, left = pairs.pair_masks(d, c)
    assert [r.stem for r in good.collect()] == ["1"] and [r.image for r in left.collect()] == ["x/9.png"]


def test_augment(spark):
    m = np.zeros((16, 16), int)
    m[4:12, 4:12] = 255
    df = spark.createDataFrame([(b, b, m.ravel().tolist(), 16, 16) for b in range(40)], "batch int, id int, mask array<int>, height int, width int")
    got = augment.augment(df, seed=2, ranges=augment.NARROW).collect()
    assert got == augment.augment(df, seed=2, ranges=augment.NARROW).collect()
    assert {r.mode for r in got} >= {"shrink", "expand"} and all(r.gt_mask == m.ravel().tolist() for r in got)
    for r in got:
        n = sum(x > 0 for x in r.mask)
        assert n <= 64 if r.mode == "shrink" else n >= 64 if r.mode == "expand" else True
    assert (augment.augmented(m, "unknown", {}) == m).all()
    assert augment.augment(df.drop("mask")).columns == ["batch", "id", "height", "width"]
    blank = df.withColumn("mask", F.lit(None).cast("array<int>")).limit(3)
    assert all(r.mask is None for r in augment.augment(blank).collect())


def test_slots(spark):
    assert slots.instantiate({"target": "collections.Counter", "params": {"a": 2}})["a"] == 2
    with pytest.raises(KeyError):
        slots.instantiate({})
    counted = slots.apply_model(spark.range(3), lambda: lambda row: row["id"] * 2, "twice", "bigint", pa.int64())
    assert [r.twice for r in counted.orderBy("id").collect()] == [0, 2, 4]


def test_best_boxes(spark):
    boxes = [(0, 0, 1, 1, 0.5), (1, 0, 2, 1, 0.9), (2, 0, 3, 1, 0.29), (3, 0, 4, 1, 0.5), (4, 0, 5, 1, 0.3)]
    df = spark.createDataFrame([(1, boxes), (2, []), (3, None)], "id int, boxes array<struct<x1:int,y1:int,x2:int,y2:int,score:double>>")
    got = {r.id: [b.x1 for b in r.b] for r in df.select("id", best_boxes(F.col("boxes"), 0.3, 3).alias("b")).collect()}
    assert got == {1: [1, 0, 3], 2: [], 3: []}


def test_curation(spark):
    bg = np.full((32, 32, 3), 60, np.uint8)
    shot = bg.copy()
    shot[8:20, 8:20] = 240
    box = [(8, 8, 20, 20, 0.9)]
    rows = [(1, 32, 32, 32, 32, bg, shot, box), (2, 32, 32, 32, 32, bg, bg, box), (3, 32, 32, 16, 32, bg, shot, box), (4, 32, 32, 32, 32, None, shot, box), (5, 32, 32, 32, 32, bg[:1], shot, box), (6, 32, 32, 32, 32, bg, shot, []), (7, 32, 32, 32, 32, bg, shot, None), (8, 32, 32, 32, 32, bg, shot, [(0, 0, 2, 2, 0.9)]), (9, 32, 32, 32, 32, bg, shot, [(8, 8, 16, 18, 0.9)]), (10, 32, 32, 32, 32, bg, shot, [(18, 18, 30, 30, 0.1), (19, 19, 20, 20, 0.4)])]
    objects = np.zeros((32, 32), int)
    objects[18:24, 18:24] = 7
    data = [(*r[:5], *(None if x is None else bytearray(x.tobytes()) for x in r[5:7]), r[7], objects.ravel().tolist(), "x") for r in rows]
    df = spark.createDataFrame(data, "sample long, height int, width int, bg_height int, bg_width int, bg binary, shot binary, boxes array<struct<x1:int,y1:int,x2:int,y2:int,score:double>>, objects array<int>, mask string")
    set_ = Settings(disk=1, least_area=20, most_hole=10, expand=1.0)
    got = {r.sample: r for r in curate(df, set_).collect()}
    want = {1: "pass", 2: "diff_quality_empty_mask", 3: "shape_mismatch", 4: "image_load_error", 5: "error", 6: "no_semantic_targets", 7: "no_semantic_targets", 8: "no_valid_regions", 9: "scale_overflow_aligned", 10: "background_collapse"}
    assert {k: r.reason for k, r in got.items()} == want and all(r.is_valid == (r.reason == "pass") and (r.mask is not None) == r.is_valid for r in got.values())
    mask = np.frombuffer(got[1].mask, np.uint8).reshape(32, 32)
    assert mask[10:18, 10:18].all() and mask[19, 19] and not mask[21, 21]
    plain = curate(df.withColumn("objects", F.lit(None)), set_).filter("is_valid").first()
    assert 0 < sum(plain.mask) <= mask.sum()
    assert curate(df.limit(0)).count() == 0


def test_stream(spark, tmp_path):
    schema = "category string, source double, edited double"
    spark.createDataFrame([("Add object", 1.0, 2.0), ("Remove object", 3.0, 4.0), ("Other", 5.0, 6.0)], schema).write.parquet(str(tmp_path / "in"))
    arriving = arrivals.arriving(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    for _ in range(2):  # the second run finds nothing new
        arrivals.write_available(arrivals.oriented(arriving), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert {(r.bg, r.shot) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1.0, 2.0), (4.0, 3.0)}


def test_columns_and_names(spark):
    import pairloom
    from pairloom.operators.columns import transformed, with_new_columns

    df = spark.range(2)
    with pytest.raises(ValueError, match="id"):
        with_new_columns(df, {"id": F.lit(1)})
    assert transformed(df).columns == ["id"] and transformed(df, lambda d: d.withColumn("x", F.lit(1))).columns == ["id", "x"]
    assert all(callable(getattr(pairloom, n)) for n in pairloom.__all__)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_numbering_in_many_ranges(spark, monkeypatch):
    """Ranges of a few rows at two levels, a key that many rows share, and groups dealt to slots."""
    from pyspark.sql import functions as F

    from pairloom.operators import order

    monkeypatch.setattr(order, "RANGE_ROWS", 20)
    rows = [(f"k{(i * 7919) % 997:04}", i) for i in range(900)] + [("k0500", 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, n long").repartition(5)
    got = order.dense_index(df, "key", "n", total="all").collect()
    assert [(r.key, r.n) for r in sorted(got, key=lambda r: r.idx)] == sorted(rows) and {r["all"] for r in got} == {1200}
    assert [r.idx for r in sorted(got, key=lambda r: r.idx)] == list(range(1200))
    empty = order.dense_index(df.filter("false"), "key")
    assert empty.count() == 0
    plain = order.chunked(df, ["key"], ["n"], 7, True).collect()
    dealt = order.chunked(df, ["key"], ["n"], 7, True, F.floor(F.col("n") / 100).cast("int")).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, dealt)) and len(plain) > 200
