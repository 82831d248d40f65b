"""Headers, the committing sink, lists, maps and differing rows on small files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import cells
from pairloom.operators.metrics import sample_grid
from pairloom.sources import headers, images, picture_sink, sinks, tables
from pairloom.sources.files import file_system


def size(data):
    return headers.picture_size(lambda at, n: data[at : at + n])


def jpeg(*segments, start=b"\xff\xd8"):
    return start + b"".join(b"\xff" + bytes([m]) + (len(x) + 2).to_bytes(2, "big") + x for m, x in segments)


FRAME = (0xC0, b"\x08" + (300).to_bytes(2, "big") + (700).to_bytes(2, "big") + b"\x03")


def test_headers():
    assert size(images.png(np.zeros((3, 70000, 3), np.uint8))) == (70000, 3)
    assert size(jpeg((0xE0, b"x" * 14), FRAME)) == (700, 300)
    assert size(jpeg((0xE1, b"x" * 65533), (0xC4, b"y" * 9), (0xC2, FRAME[1]))) == (700, 300)
    assert size(jpeg(FRAME, start=b"\xff\xd8\xff\xff\xff\xd0\xff\x01")) == (700, 300)
    for data in (b"", b"\xff", b"\x89PNG\r\n\x1a\n", jpeg(), jpeg((0xE0, b"x")), jpeg((0xDA, b"x"), FRAME), jpeg(FRAME)[:9], b"\xff\xd8\xff\xe0\x00\x01" + jpeg(FRAME)[2:], b"\xff\xd8\x00\x00", b"GIF89a" + bytes(20)):
        assert size(data) is None
    assert size(jpeg((0xC0, b"\x08\x00\x00\x00\x05\x03"))) is None  # a height of 0


def test_probe_reads_ranges(spark, tmp_path):
    (tmp_path / "far.jpg").write_bytes(jpeg(*[(0xE2, b"z" * 65000)] * 40, FRAME) + bytes(100))
    (tmp_path / "none.png").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_bytes(b"nothing")
    got = {os.path.basename(r.path): (r.width, r.height) for r in headers.probe_folder(spark, str(tmp_path)).collect()}
    assert got == {"far.jpg": (700, 300), "none.png": (512, 512)}
    lost = spark.createDataFrame([(str(tmp_path / "gone.png"),), (None,)], "path string")
    assert [(r.width, r.height) for r in headers.probed_sizes(lost).collect()] == [(512, 512)] * 2
    assert headers.header_sizes(spark.createDataFrame([], "content binary")).count() == 0
    with pytest.raises(ValueError):
        file_system("nosuch://x/y")


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.startswith("."))


def rows(spark, *names):
    return spark.createDataFrame([(n, bytearray(n.encode())) for n in names], "name string, data binary").repartition(3)


def test_sink_commits(spark, tmp_path):
    folder = str(tmp_path / "out")
    picture_sink.write_pictures(rows(spark, "a/1.png", "a/2.png", "b/1.png", "a/2.png"), folder)
    assert files(folder) == ["_SUCCESS", "a/1.png", "a/2.png", "b/1.png"]
    picture_sink.write_pictures(rows(spark, "a/1.png", "c.png"), f"file:{folder}")
    assert files(folder) == ["_SUCCESS", "a/1.png", "a/2.png", "b/1.png", "c.png"]
    assert (tmp_path / "out/a/2.png").read_bytes() == b"a/2.png"
    picture_sink.write_pictures(rows(spark, "d.png"), folder, mode="overwrite")
    assert files(folder) == ["_SUCCESS", "d.png"]
    picture_sink.write_pictures(rows(spark, "d.png").limit(0), str(tmp_path / "empty"))
    assert files(str(tmp_path / "empty")) == ["_SUCCESS"]


@pytest.mark.parametrize("bad", ["../up.png", "/top.png", "a/../../up.png"])
def test_sink_shows_nothing_of_a_failed_job(spark, tmp_path, bad):
    folder = str(tmp_path / "out")
    picture_sink.write_pictures(rows(spark, "old.png"), folder)
    with pytest.raises(Exception, match="no name of a file"):
        picture_sink.write_pictures(rows(spark, "new/1.png", "new/2.png", "new/3.png", bad), folder)
    assert files(folder) == ["_SUCCESS", "old.png"] and not (tmp_path / "up.png").exists()
    nothing = spark.createDataFrame([("x.png", None)], "name string, data binary")
    with pytest.raises(Exception):
        picture_sink.write_pictures(nothing, folder)
    assert files(folder) == ["_SUCCESS", "old.png"]


def test_an_attempt_that_lost_leaves_nothing(tmp_path):
    from pyspark.sql import Row
    from pyspark.sql.types import StructType

    writer = picture_sink.PictureWriter(StructType.fromDDL("name string, data binary"), str(tmp_path), False)
    row = [Row(name="a.png", data=b"1")]
    writer.write(iter([Row(name="lost.png", data=b"0")]))  # its executor went before it could report
    writer.commit([writer.write(iter(row)), None])
    assert files(str(tmp_path)) == ["_SUCCESS", "a.png"]


def test_core_masks_are_written_by_their_ratio(spark, tmp_path):
    df = spark.createDataFrame([("1", 1, 2, [0, 1], 0.15), ("2", 1, 2, [1, 1], 0.16), ("3", 1, 2, None, 0.9)], "stem string, height int, width int, mask array<int>, ratio double")
    got = sinks.core_files(df).filter("data is not null").collect()
    assert [r.name for r in got] == ["masks_object/2.png"]
    picture_sink.write_pictures(sinks.mask_files(df.filter("mask is not null")), str(tmp_path))
    back = images.picture_sums(images.read_images(spark, str(tmp_path / "masks"))).orderBy("path").collect()
    assert [(r.channels, r.total) for r in back] == [(1, 255), (1, 510)]


def test_lines_are_numbered_over_blocks_and_parts(spark, tmp_path):
    lines = [f"p/{k}.png" if k % 5 else f"  /q/{k}.png\t" for k in range(2000)]
    (tmp_path / "one.txt").write_text("\n \n".join(lines) + "\n\n")
    os.mkdir(tmp_path / "parts")
    for k in range(4):
        (tmp_path / f"parts/part-{k}").write_text("\n".join(lines[k * 500 : k * 500 + 500]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        want = [(k, x.strip() if x.strip().startswith("/") else f"/root/{x}") for k, x in enumerate(lines)]
        for name in ("one.txt", "parts"):
            got = tables.read_manifest(spark, str(tmp_path / name), "/root/").collect()
            assert sorted((r.line, r.path) for r in got) == want
        both = tables.zip_manifests(spark, {"a": str(tmp_path / "one.txt"), "b c": str(tmp_path / "parts")}, "/root").orderBy("idx").collect()
        assert [(r.idx, r.a) for r in both] == want and all(r.a == r["b c"] for r in both)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lists_of_different_length_raise(spark, tmp_path):
    (tmp_path / "a").write_text("x\ny\n")
    (tmp_path / "b").write_text("x\n")
    (tmp_path / "none").write_text("\n")
    for other in ("b", "none"):
        with pytest.raises(Exception, match="lists of different length: no line"):
            tables.zip_manifests(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / other)}, "/").count()
    assert tables.zip_manifests(spark, {"a": str(tmp_path / "none"), "b": str(tmp_path / "none")}, "/").count() == 0


def test_map_parts_are_one_object(spark, tmp_path):
    entries = {f"{k:03}": f'é "{k}" \\ \n {{}},' for k in range(300)}
    df = spark.createDataFrame([*entries.items(), ("null", None)], "stem string, prompt string").repartition(7)
    sinks.write_map(df, str(tmp_path / "map"))
    whole = "\n".join((tmp_path / "map" / f).read_text() for f in sorted(os.listdir(tmp_path / "map")) if f.startswith("part-"))
    assert json.loads(whole) == {**entries, "null": ""} and list(json.loads(whole)) == [*entries, "null"]
    assert whole.strip() == json.dumps({**entries, "null": ""}, ensure_ascii=False, indent=2)
    assert {r.stem: r.prompt for r in tables.read_map(spark, str(tmp_path / "map")).collect()} == {**entries, "null": ""}
    sinks.write_map(df.limit(0), str(tmp_path / "none"))
    assert tables.read_map(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "flat.json").write_text(json.dumps({"a": "{", "b": "2"}))
    assert {r.stem: r.prompt for r in tables.read_map(spark, str(tmp_path / "flat.json")).collect()} == {"a": "{", "b": "2"}


def test_columns_follow_the_first_sight_of_a_key(spark):
    data = [(3, '{"z": 1, "a b": [1]}'), (1, '{"m": {"x": 1}, "it\'s": "t"}'), (2, "no object"), (4, None), (5, '{"m": null, "a": 2.5}')]
    df = spark.createDataFrame(data, "id int, props string")
    wide = tables.key_columns(df, "id", "props", missing='"-"')
    assert wide.columns == ["id", "m", "it's", "z", "a b", "a"]
    got = {r[0]: list(r[1:]) for r in wide.select("id", *[F.to_json(F.col(f"`{c}`")).alias(c) for c in wide.columns[1:]]).collect()}
    assert got[1] == ['{"x":1}', '"t"', '"-"', '"-"', '"-"'] and got[2] == ['"-"'] * 5 and got[5] == ["null", '"-"', '"-"', '"-"', "2.5"]
    assert tables.key_columns(df.limit(0), "id", "props").columns == ["id"]
    with pytest.raises(ValueError, match="different keys"):
        tables.key_columns(df, "id", "props", most=2)


def test_grids_of_one_to_many_images(spark):
    def grid(n, across=4, most=4):
        df = spark.createDataFrame([(0, k, [k + 1.0] * 6) for k in range(n)], "step int, pos int, v array<double>")
        r = sample_grid(df, 2, 3, most, across).first()
        return np.array(r.grid).reshape(r.grid_height, r.grid_width)

    assert grid(1).shape == (2, 3) and grid(2).shape == (6, 12) and grid(9).shape == (6, 22) and grid(5, 2, 5).shape == (14, 12)
    g = grid(5, 2, 5)
    assert (g[2:4, 2:5] == 1).all() and (g[2:4, 7:10] == 2).all() and (g[6:8, 2:5] == 3).all() and (g[10:12, 2:5] == 5).all()
    assert g.sum() == 6 * 15


def test_widths(spark):
    cases = {"": 0, "abc": 3, "日本": 4, "é": 1, "\x1b[31mred\x1b[0m": 3, "ＡＢ": 4, "a​b": 2, "one\nthree": 5, "\x1b]8;;http://x\x1b\\link\x1b]8;;\x1b\\": 4, "한국어": 6, "🙂": 2}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r.c: r.w for r in df.select("c", cells.visible_width(F.col("c")).alias("w")).collect()} == cases
    own = spark.range(1).select(cells.as_text(F.lit("a�é").cast("binary")).alias("x"), cells.as_text(F.unhex(F.lit("61FFC3")))).first()
    assert tuple(own) == ("a�é", "a")


def test_probes_are_not_sorted_into_a_few_tasks(spark, tmp_path):
    from pairloom.sources import headers

    (tmp_path / "a.png").write_bytes(b"no picture")
    probed = headers.probe_folder(spark, str(tmp_path))
    assert "Sort" not in probed._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.width, r.height) for r in probed.collect()] == [(512, 512)]


def test_commit_holds_a_list_of_names_at_a_time(spark, tmp_path):
    import pickle

    from pyspark.sql import Row
    from pyspark.sql.types import StructType

    writer = picture_sink.PictureWriter(StructType.fromDDL("name string, data binary"), str(tmp_path), False)
    messages = [writer.write(Row(name=f"a/{k % 6000:05}.png", data=b"x") for k in range(t * 3000, t * 3000 + 5000)) for t in range(3)]
    # what a task reports doesn't grow with its files
    assert all(len(pickle.dumps(m)) < 300 for m in messages)
    writer.commit(messages)
    assert files(str(tmp_path)) == ["_SUCCESS", *(f"a/{k:05}.png" for k in range(6000))]


def test_pictures_are_listed_and_read_by_tasks(spark, tmp_path):
    r = np.random.default_rng(1)
    pictures = {f"{k}.png": r.integers(0, 256, (3, 1 + k) if k % 2 else (2, 1 + k, 3), np.uint8) for k in range(50)}
    (tmp_path / "one").mkdir()
    for name, x in pictures.items():
        (tmp_path / "one" / name).write_bytes(images.png(x))
    for name, data in {"broken.png": b"no picture", "odd 50%20.PNG": images.png(pictures["1.png"]), "_hidden.png": b"", "note.txt": b""}.items():
        (tmp_path / "one" / name).write_bytes(data)
    for start in ("", "file:", "file://"):
        paths = images.images_below(spark, f"{start}{tmp_path}/one", f"{start}{tmp_path}/none", missing_ok=True)
        # Spark's own readers keep a list of all files in the driver
        assert "FileScan" not in paths._jdf.queryExecution().executedPlan().toString() and paths.rdd.getNumPartitions() == 4
        base = lambda df: {os.path.basename(x.path): tuple(x)[1:] for x in df.collect()}
        got, want = base(images.read_pngs(paths)), base(images.read_images(spark, f"{tmp_path}/one").filter("path not like '%.txt'"))
        assert got.pop("odd 50%20.PNG") == got["1.png"] and got.pop("broken.png")[:3] == (-1, -1, -1)
        assert {k: v for k, v in want.items() if k in pictures} == got
        probed = base(headers.probed_sizes(paths))
        assert probed["odd 50%20.PNG"] == (2, 3) and probed["7.png"] == (8, 3) and len(probed) == 52
    with pytest.raises(Exception, match="none"):
        images.images_below(spark, f"{tmp_path}/none").count()


@pytest.mark.parametrize("kind, bpp", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_filters(spark, tmp_path, kind, bpp):
    import struct
    import zlib

    r = np.random.default_rng(kind)
    raw = r.integers(0, 256, (10, 1 + 7 * bpp), np.uint8)
    raw[:, 0] = np.arange(10) % 5
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    data = lambda depth, body: images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, depth, kind, 0, 0, 0)) + b"".join(chunk(b"IDAT", body[k : k + 50]) for k in range(0, len(body), 50)) + chunk(b"IEND", b"")
    good = data(8, zlib.compress(raw.tobytes()))
    (tmp_path / "x.png").write_bytes(good)
    want = images.read_images(spark, str(tmp_path)).first()
    x = images.from_png(good)
    assert (x.shape, x.tobytes()) == ((want.height, want.width, want.channels), bytes(want.data))
    assert images.from_png(good[:80]) is None and images.from_png(data(8, zlib.compress(raw.tobytes()[:-1]))) is None
    with pytest.raises(ValueError):
        images.from_png(data(16, zlib.compress(raw.tobytes())))
