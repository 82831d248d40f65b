"""The registered queries of sources and sinks: tables written as files below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as cell_functions
from ..functions import pixels as px
from ..operators import metrics as metric_operators
from ..operators.order import worker_shares
from ..operators.text_table import text_table
from ..sources import headers, images, picture_sink, shards, sinks, tables
from ..sources.files import scratch_folder
from . import views
from .picture_queries import colours
from .queries import H, HEAT, W, exploded, grid_pairs, query, rounded

SHARDS, EXCLUDED = 5, (3,)


# --- shards ---------------------------------------------------------------------------------------------------------


def shard_folder(spark: SparkSession, sf_dir: str) -> str:
    """The edits in a few shards by their names, each in the order of its events."""
    folder, rows = scratch_folder(spark, "shards"), views.edits(spark, sf_dir)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for k in range(SHARDS):
        rows.filter(F.col("row") % SHARDS == k).select("category", "row", "source", "edited", "instruction").orderBy("row").coalesce(1).write.parquet(f"{folder}/{k}")
        part = next(p for s in fs.listStatus(jvm.Path(f"{folder}/{k}")) if (p := s.getPath()).getName().endswith(".parquet"))
        fs.rename(part, jvm.Path(f"{folder}/{shards.shard_name(k, SHARDS)}"))
        fs.delete(jvm.Path(f"{folder}/{k}"), True)
    return folder


@query
def shard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the shards that are not held out, with the shard of their file and their place in it."""
    folder = shard_folder(spark, sf_dir)
    own = spark.read.parquet(*shards.list_shards(spark, folder, EXCLUDED))
    return own.select(shards.shard_id(F.col("_metadata.file_path")).cast("long").alias("shard"), F.col("_metadata.row_index").alias("place"), "row", "category")


@query
def shard_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that read one column of the shards."""
    found = shards.category_counts(spark, shard_folder(spark, sf_dir), EXCLUDED)
    return found.select(F.col("shard").cast("long").alias("shard"), "category", "n")


@query
def one_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard found by its number."""
    return shards.read_shard(spark, shard_folder(spark, sf_dir), 2, SHARDS).select("row", "source")


# --- lists and maps -------------------------------------------------------------------------------------------------


def _list(spark: SparkSession, sf_dir: str, folder: str, name: str, line: Column) -> str:
    """A list in several parts, with blank lines in it."""
    rows = views.table(spark, sf_dir, "documents").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    lines = F.explode(F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("  "), line, F.lit(""))).otherwise(F.array(line)))
    rows.select(lines.alias("value")).write.text(f"{folder}/{name}")
    return f"{folder}/{name}"


def _path(side: str) -> Column:
    return F.format_string(f"{side}/%06d.png", "doc_id")


@query
def manifest_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lists line by line; some paths are absolute, some have spaces around them."""
    folder = scratch_folder(spark, "lists")
    shot = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/elsewhere/"), _path("shot"))).otherwise(_path("shot"))
    lines = {"shot": shot, "mask": F.concat(F.lit(" \t"), _path("mask"), F.lit("  ")), "sam": _path("sam"), "bg": _path("bg")}
    return tables.zip_manifests(spark, {name: _list(spark, sf_dir, folder, name, line) for name, line in lines.items()}, "/data/")


@query
def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_manifest(spark, _list(spark, sf_dir, scratch_folder(spark, "lists"), "shot", _path("shot")), "/data")


@query
def delimited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of lines cut at runs of white space."""
    folder = scratch_folder(spark, "cells")
    part = views.table(spark, sf_dir, "part")
    part.select(F.explode(F.array(F.concat_ws(" \t ", F.col("p_partkey").cast("string"), F.regexp_replace("p_brand", " ", "_"), F.col("p_size").cast("string"), F.lit("")), F.lit("   ")))).write.text(f"{folder}/lines")
    cells = tables.read_delimited(spark, f"{folder}/lines").filter(F.size("parts") == 3)
    return cells.select(F.col("parts")[0].cast("long").alias("key"), F.col("parts")[1].alias("brand"), F.col("parts")[2].cast("long").alias("size"))


@query
def json_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts written as one JSON object in parts and read back, with quotes, breaks and letters beyond ASCII in them."""
    folder = scratch_folder(spark, "map")
    prompts = views.table(spark, sf_dir, "documents").select(_path("x").alias("stem"), F.concat(F.lit('say "é" \\ '), F.col("text")).alias("prompt"))
    sinks.write_map(prompts, f"{folder}/prompts.json")
    found = tables.read_map(spark, f"{folder}/prompts.json")
    return found.select("stem", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query
def variant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of differing keys side by side: a column for every key that any row has."""
    e = views.table(spark, sf_dir, "events")
    more = F.concat(F.lit(', "'), F.col("event_type"), F.lit('": ['), F.col("user_id").cast("string"), F.lit("]}"))
    props = F.when(F.col("event_id") % 3 == 0, "{}").when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(F.rtrim(F.col("props"), F.lit("}")), more))
    wide = tables.key_columns(e.select("event_id", props.alias("props")), "event_id", "props", missing='"none"')
    text = lambda c: F.coalesce(F.try_variant_get(c, "$", "string"), F.to_json(c))
    return wide.select("event_id", *[text(F.col(f"`{c}`")).alias(c) for c in wide.columns if c != "event_id"])


@query
def prompt_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of all embeddings, kept as a cache of one row and read beside every row."""
    from ..operators.columns import beside_row

    folder, e = scratch_folder(spark, "cache"), views.table(spark, sf_dir, "embeddings")
    mean = e.agg(*[F.avg(F.col("embedding")[k].cast("double")).alias(f"v{k}") for k in range(4)])
    tables.write_cache(mean.select(F.array("v0", "v1", "v2", "v3").alias("vector")), f"{folder}/one")
    rows = beside_row(e.select("vec_id", "embedding"), tables.read_cache(spark, f"{folder}/one"))
    return rows.select("vec_id", rounded(F.col("embedding")[1] - F.col("vector")[1]).alias("off"))


# --- pictures -------------------------------------------------------------------------------------------------------


@query
def header_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by the headers of PNG and JPEG files, broken ones among them."""
    w, h = F.col("n_chars") % 5000 + 1, F.col("doc_id") % 4000 + 1
    wide = lambda x, n: F.lpad(F.hex(x), n, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), wide(w, 8), wide(h, 8), F.lit("0802000000"))
    skipped = F.col("doc_id") * 37 % 3000
    segment = F.concat(F.lit("FFE1"), wide(skipped + 2, 4), F.repeat(F.lit("AB"), skipped.cast("int")))
    frame = lambda marker, width: F.concat(F.lit(f"{marker}001108"), wide(h, 4), wide(width, 4), F.lit("03011100021101031101"))
    start = F.lit("FFD8FFE000104A46494600010100000100010000")
    kinds = [
        png,
        F.concat(start, segment, frame("FFC0", w)),
        F.concat(start, F.lit("FFFFFFC4000400AA"), segment, segment, frame("FFC2", w)),
        F.substring(png, 1, 40),
        F.hex(F.lit("no picture at all")),
        F.concat(start, segment, frame("FFC0", F.lit(0).cast("long"))),
        F.concat(start, segment),
    ]
    data = F.unhex(F.element_at(F.array(*kinds), (F.col("doc_id") % len(kinds) + 1).cast("int")))
    found = headers.header_sizes(views.table(spark, sf_dir, "documents").select("doc_id", data.alias("content")))
    return found.select("doc_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


@query
def picture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs, masks, cores of objects and results written as picture files, then listed, probed and decoded."""
    folder = scratch_folder(spark, "pictures")
    own = grid_pairs(spark, sf_dir).select("id", F.format_string("%06d", "id").alias("stem"), F.lit(H).alias("height"), F.lit(W).alias("width"), "a", "b")
    # the pictures of the pairs are made for the pairs alone, not again for each of the writes below
    pairs = own
    for side, value in (("bg", "a"), ("shot", "b")):
        pairs = images.with_png(pairs.withColumn("pixels", colours(F.col(value))), "pixels", 3, side)
    picture_sink.write_pictures(sinks.pair_files(pairs), folder)
    masked = own.withColumn("mask", px.binary(F.col("a"), HEAT))
    picture_sink.write_pictures(sinks.mask_files(masked), folder)
    total = lambda c: px.total(c.cast("array<double>"))
    ratio = total(F.zip_with(px.binary(F.col("b"), HEAT), "mask", lambda x, y: F.greatest(x - y, F.lit(0)))) / F.greatest(total(F.col("mask")), F.lit(1.0))
    picture_sink.write_pictures(sinks.core_files(masked.withColumn("ratio", ratio), 0.8), folder)
    shade = lambda i: ((F.col("id") * 31 + 7 * F.floor(F.floor(i / 3) / 5) + 13 * (F.floor(i / 3) % 5) + 50 * (i % 3)) % 256).cast("int")
    results = own.select("id", "stem", F.lit(7).alias("height"), F.lit(5).alias("width"), F.lit(H).alias("to_height"), F.lit(W).alias("to_width"), F.transform(F.sequence(F.lit(0), F.lit(7 * 5 * 3 - 1)), shade).alias("result"))
    picture_sink.write_pictures(sinks.result_files(results), folder)
    # folders into which nothing was written are not there
    paths = images.images_below(spark, *(f"{folder}/{kind}" for kind in ("bg", "shot", "masks", "masks_object", "results")), missing_ok=True)
    found = headers.probed_sizes(images.picture_sums(images.read_pngs(paths)))
    name = F.regexp_extract("path", r"([^/]*/[^/]*)$", 1).alias("name")
    return found.select(name, F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.col("channels").cast("long").alias("channels"), "total", "placed")


@query
def sample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four pictures of each step side by side, with two empty pixels around each."""
    g = views.grids(spark, sf_dir).select(F.expr("id div 9").alias("step"), F.col("id").alias("pos"), "v").filter("step % 4 <> 0 or pos % 9 = 0")
    found = metric_operators.sample_grid(g, H, W)
    return found.select("step", F.col("grid_height").cast("long").alias("grid_height"), F.col("grid_width").cast("long").alias("grid_width"), F.posexplode("grid").alias("p", "v")).withColumns({"p": F.col("p").cast("long"), "v": rounded(F.col("v"))})


# --- logs, metrics, checkpoints -------------------------------------------------------------------------------------


@query
def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics appended in two goes and read back."""
    folder, log = f"{scratch_folder(spark, 'metrics')}/log", views.metrics(spark, sf_dir)
    sinks.append_metrics(log.filter("step % 2 = 0"), folder)
    sinks.append_metrics(log.filter("step % 2 = 1"), folder)
    return spark.read.parquet(folder).groupBy("metric").agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"), F.max("step").alias("last"))


@query
def worker_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results logged by worker, and how many failed by reason."""
    folder = f"{scratch_folder(spark, 'log')}/workers"
    items = views.table(spark, sf_dir, "events").select(F.format_string("%09d", "event_id").alias("stem"), F.when(F.col("event_type") == "error", "image_load_error").when(F.col("value") > 50, "high_noise").otherwise("pass").alias("reason"))
    sinks.write_log(worker_shares(items, "stem", 4).select("worker", "stem", "reason"), folder)
    return spark.read.schema("stem string, reason string, worker long").json(folder).groupBy("worker", "reason").agg(F.count("*").alias("n"), F.min("stem").alias("first"))


@query
def checkpoint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five checkpoints of which three may stay; the newest is read."""
    folder, part = scratch_folder(spark, "checkpoints"), views.table(spark, sf_dir, "part")
    for step in (2, 9, 10, 100, 1000):
        sinks.save_checkpoint(part.select("p_partkey", (F.col("p_size") + step).alias("weight")), folder, step, 3)
    left = spark.read.parquet(*[f"{folder}/checkpoint-{s}" for s in (10, 100, 1000)])
    step = F.element_at(F.split("_metadata.file_path", "checkpoint-"), -1)
    counted = left.select(F.split(step, "/")[0].cast("long").alias("step"), "weight").groupBy("step").agg(F.count("*").alias("n"), F.sum("weight").alias("weights"))
    return counted.withColumn("is_latest", F.col("step") == sinks.latest_step(spark, folder))


# --- cells ----------------------------------------------------------------------------------------------------------


@query
def visible_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that texts take on a screen, with colours, wide characters, marks and several lines."""
    t = views.table(spark, sf_dir, "conversations")
    decorated = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m"), F.when(F.col("turn") % 2 == 0, "\n日本語テキスト ＡＢＣ 한국어").otherwise("é ä"))
    return t.select("conv_id", "turn", cell_functions.visible_width(decorated).cast("long").alias("width"), cell_functions.display_width(F.concat(F.col("role"), F.lit("漢字​🙂"))).cast("long").alias("one_line"))


@query
def point_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of different decimals with their points below each other."""
    part = views.table(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast("decimal(18,2)")
    cell = F.when(F.col("p_partkey") % 3 == 0, price.cast("string")).when(F.col("p_partkey") % 3 == 1, F.col("p_size").cast("string")).otherwise(price.cast("decimal(18,1)").cast("string"))
    rows = part.select("p_partkey", cell.alias("cell"))
    return rows.select("p_partkey", cell_functions.point_aligned(F.col("cell"), F.lit(14), F.lit(2)).alias("aligned"))


@query
def bytes_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which a byte that ends nothing was put in; it goes, the rest stays."""
    d = views.table(spark, sf_dir, "documents")
    data = F.concat(F.unhex(F.lit("FF")), F.col("text").cast("binary"), F.unhex(F.lit("EFBFBDC3")))
    return d.select("doc_id", F.md5(cell_functions.as_text(data).cast("binary")).alias("text_md5"))


def _parts_table(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    found = text_table(part, "p_partkey", fmt=fmt)
    return found.select(F.col("section").cast("long").alias("section"), "p_partkey", F.col("at").cast("long").alias("place"), "line")


@query
def text_table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as a table drawn with lines."""
    return _parts_table(spark, sf_dir, "grid")


@query
def text_table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as a table of markup."""
    return _parts_table(spark, sf_dir, "html")
