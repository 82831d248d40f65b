"""The registered queries of the curation operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as box_functions
from ..functions import cells as cell_functions
from ..functions import pixels as px
from ..functions import raster
from ..operators import batches, metrics, pairs
from ..operators import boxes as box_operators
from ..operators.columns import beside_row, with_new_columns
from ..operators.order import positional_join, skip_first, worker_shares
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
HELD_OUT = (3,)
HEAT = 0.07
W = H = 8


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(x, digits: int = 6):
    return F.round(x, digits) + F.lit(0.0)


# --- shards and pairs -----------------------------------------------------------------------------------------------


@query
def ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.ordered_pairs(views.edits(spark, sf_dir), HELD_OUT)


@query
def shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.shard_counts(views.edits(spark, sf_dir))


@query
def heldout_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.edits(spark, sf_dir).filter(~F.col("shard").isin(*HELD_OUT))
    return rows.groupBy("shard").agg(F.count("*").alias("n"))


@query
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.shard_counts(views.edits(spark, sf_dir)).agg(F.sum("n_add").alias("n_add"), F.sum("n_remove").alias("n_remove"))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return views.images(spark, sf_dir, "bg"), views.images(spark, sf_dir, "shot")


@query
def stem_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_by_stem(*_both(spark, sf_dir))


@query
def pairs_with_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.pair_by_stem(*_both(spark, sf_dir))
    return pairs.with_prompts(found, pairs.last_prompts(views.prompts(spark, sf_dir))).select("stem", "bg_path", "shot_path", "prompt")


@query
def last_wins_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.prompts(spark, sf_dir)
    return pairs.last_prompts(p.filter("seq % 2 = 0"), p.filter("seq % 2 = 1"))


@query
def common_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.common_stems(*_both(spark, sf_dir))


@query
def unmatched_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_masks(*_both(spark, sf_dir), by="stem")[1]


@query
def fallback_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_masks(*_both(spark, sf_dir), by="stem")[0]


@query
def counted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of the same length: by position, whatever the files are called."""
    return pairs.pair_masks(*_both(spark, sf_dir))[0]


@query
def positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bg, shot = _both(spark, sf_dir)
    return positional_join(bg.select(F.col("path").alias("bg_path")), shot.select(F.col("path").alias("shot_path")), "bg_path", "shot_path")


@query
def ext_priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bg, shot = _both(spark, sf_dir)
    masks = bg.select(F.regexp_replace("path", "^bg/", "masks/mask_").alias("path"))
    return pairs.preferred_image(masks, shot)


@query
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return views.images(spark, sf_dir, "bg").select("path", pairs.stem_of(p).alias("stem"), pairs.suffix_of(p).alias("suffix"), pairs.without_mask_prefix(F.concat(F.lit("mask_"), pairs.stem_of(p))).alias("bare"))


@query
def worker_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worker_shares(pairs.last_by_stem(views.images(spark, sf_dir, "bg")).select("stem"), "stem", 8).select("stem", "worker")


@query
def worker_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worker_ranges(spark, sf_dir).groupBy("worker").agg(F.count("*").alias("n"), F.min("stem").alias("first"), F.max("stem").alias("last"))


@query
def start_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stems from the 50th on, to go on with an interrupted run."""
    return skip_first(pairs.last_by_stem(views.images(spark, sf_dir, "bg")).select("stem"), "stem", 50)


@query
def prompt_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fixed prompt, cached as a table of one row, beside every pair."""
    prompt = spark.range(1).select(F.lit("remove the object").alias("prompt"), F.array(F.lit(0.5), F.lit(-0.5)).alias("vector"))
    return beside_row(pairs.pair_by_stem(*_both(spark, sf_dir)), prompt).select("stem", "prompt", F.col("vector")[0].alias("first"))


@query
def ragged_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of different length side by side, short ones filled with nulls."""
    o = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")))).alias("r"), F.sort_array(F.collect_list(F.when(F.col("l_returnflag") != "R", F.col("l_partkey")))).alias("other")
    )
    return o.select("l_orderkey", F.posexplode(F.arrays_zip("r", "other")).alias("pos", "z")).select("l_orderkey", F.col("pos").cast("long").alias("pos"), F.coalesce("z.r", F.lit(-1).cast("long")).alias("returned"), F.coalesce("z.other", F.lit(-1).cast("long")).alias("other"))


# --- boxes ----------------------------------------------------------------------------------------------------------


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = views.boxes(spark, sf_dir)
    return b.filter("kind = 'diff'"), b.filter("kind = 'semantic'")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_operators.gathered(*_sides(spark, sf_dir))


@query
def topk_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_operators.top_detections(_sides(spark, sf_dir)[1], 3).select("sample", "pos", "rank", "score")


@query
def main_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_operators.main_regions(_sides(spark, sf_dir)[0]).select("sample", "pos", "area", "rank")


@query
def iou_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_operators.best_matches(_samples(spark, sf_dir)).withColumns({"match_pos": F.coalesce("match_pos", F.lit(-1).cast("long")), "iou": rounded(F.col("iou"))})


@query
def validate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_operators.validated(_samples(spark, sf_dir)).select("sample", "is_valid", "reason", F.size("kept").cast("long").alias("n_kept"))


@query
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_operators.reason_counts(box_operators.validated(_samples(spark, sf_dir)))


@query
def overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = _sides(spark, sf_dir)
    components = d.withColumn("area", F.floor(box_functions.area(F.struct("x1", "y1", "x2", "y2")) / 2))
    return box_operators.covered_components(components, s).select("sample", "pos", "area")


# --- batches --------------------------------------------------------------------------------------------------------


@query
def bucket_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.bucket_batches(views.resolutions(spark, sf_dir), 8, seed=1)


@query
def rank_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.rank_batches(batches.bucket_batches(views.resolutions(spark, sf_dir), 8, seed=1), 3, seed=1)


@query
def batches_per_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.batches_per_rank(views.resolutions(spark, sf_dir), 8, 3)


@query
def mode_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batches.bucket_batches(views.resolutions(spark, sf_dir), 8, seed=1).select("width", "height", "chunk").distinct()
    u = batches.uniform("mode", F.col("width"), F.col("height"), F.col("chunk"))
    return b.select("width", "height", "chunk", rounded(u, 9).alias("u"), batches.batch_mode(u, F.col("chunk") % 2 == 0).alias("mode"))


@query
def align16_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.resolutions(spark, sf_dir)
    return r.select("idx", px.up_to_multiple(F.col("width") + F.col("idx") % 17).alias("width"), px.up_to_multiple(F.col("height") + F.col("idx") % 23).alias("height"))


@query
def cap_long_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.resolutions(spark, sf_dir).withColumn("s", px.capped_size(F.col("width") * (1 + F.col("idx") % 7), F.col("height") * (1 + F.col("idx") % 5)))
    return r.select("idx", "s.width", "s.height")


@query
def short_edge_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.resolutions(spark, sf_dir).withColumn("w", F.col("width") + F.col("idx") % 41)
    return r.select("idx", px.short_edge_size(F.col("w"), F.col("height"), 320, True).alias("a"), px.short_edge_size(F.col("w"), F.col("height"), 320, False).alias("b")).select("idx", F.col("a.width").alias("train_w"), F.col("a.height").alias("train_h"), F.col("b.width").alias("infer_w"), F.col("b.height").alias("infer_h"))


# --- grids ----------------------------------------------------------------------------------------------------------


def exploded(df: DataFrame, column: str, to: str, *also: str) -> DataFrame:
    return df.select("id", *also, F.posexplode(column).alias("p", to)).withColumn("p", F.col("p").cast("long"))


def grid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid 2k and grid 2k + 1 as before and after."""
    g = views.grids(spark, sf_dir)
    a = g.filter("id % 2 = 0").select((F.col("id") / 2).cast("long").alias("id"), F.col("v").alias("a"))
    return a.join(g.filter("id % 2 = 1").select(F.expr("id div 2").alias("id"), F.col("v").alias("b")), "id")


def masks(spark: SparkSession, sf_dir: str, at: float = HEAT) -> DataFrame:
    return views.grids(spark, sf_dir).select("id", px.binary(F.col("v"), at).alias("m"))


@query
def binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(masks(spark, sf_dir), "m", "v").withColumn("v", F.col("v").cast("long"))


@query
def heat_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.grids(spark, sf_dir).select("id", rounded(px.positive_quantile(F.col("v"), 0.99)).alias("p99"), rounded(px.total(px.scaled_by_quantile(F.col("v")))).alias("heat"))


@query
def weighted_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of two pictures made of two grids: log light, Lab colour plane and Sobel texture, weighted."""
    import numpy as np
    import pyarrow as pa

    def heat(m: np.ndarray) -> list[float]:
        v = np.abs(m)
        rgb = 255 * np.stack([np.minimum(v, 1), 1 - np.minimum(v, 1), np.minimum(v * v, 1)], -1)
        return raster.difference_heat(rgb[:H], rgb[H:]).ravel().tolist()

    both = grid_pairs(spark, sf_dir).select("id", F.concat("a", "b").alias("m"))
    found = raster.map_grids(both, "m", 2 * H, W, heat, "h", "array<double>", pa.list_(pa.float64()))
    return exploded(found, "h", "v").withColumn("v", rounded(F.col("v")))


@query
def lab_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L, a and b of pixels whose red, green and blue are |v|, 1 - |v| and v * v, each times 255."""
    import numpy as np
    import pyarrow as pa

    def lab(m: np.ndarray) -> list[list[float]]:
        v = np.minimum(np.abs(m), 1)
        return raster.lab_of(255 * np.stack([v, 1 - v, v * v], -1)).reshape(-1, 3).tolist()

    found = raster.map_grids(views.grids(spark, sf_dir), "v", H, W, lab, "x", "array<array<double>>", pa.list_(pa.list_(pa.float64())))
    # the rounding of 5 digits hides the last bits of powers and roots
    return exploded(found, "x", "c").select("id", "p", *[rounded(F.col("c")[k], 5).alias(n) for k, n in enumerate(("l", "a", "b"))])


@query
def soft_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that fall from a mask's edge to nothing within three pixels."""
    import pyarrow as pa

    found = raster.map_grids(masks(spark, sf_dir, 0.15), "m", H, W, lambda m: raster.soft_edge(m, 3).ravel().tolist(), "x", "array<double>", pa.list_(pa.float64()))
    return exploded(found, "x", "v").withColumn("v", rounded(F.col("v")))


@query
def byte_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of 8-bit grids at the two thresholds, which differ at 128 only."""
    g = views.grids(spark, sf_dir).select("id", F.transform("v", lambda x: F.floor(F.abs(x) * 100.0) + 110.0).alias("v"))
    at = lambda k: px.total(px.binary(F.col("v"), k).cast("array<double>")).cast("long")
    return g.select("id", at(127.0).alias("over_127"), at(128.0).alias("over_128"))


@query
def linear_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.grids(spark, sf_dir)
    return g.select("id", rounded(px.total(F.transform("v", lambda x: px.linear_light(F.abs(x) * 255.0)))).alias("light"))


@query
def gradient_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.grids(spark, sf_dir).select("id", rounded(px.total(px.gradient_magnitude(F.col("v"), W, H)), 5).alias("gradient"))


@query
def maxpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(views.grids(spark, sf_dir).select("id", px.block_max(F.col("v"), W, H, 4).alias("m")), "m", "v").withColumn("v", rounded(F.col("v")))


@query
def area_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(views.grids(spark, sf_dir).select("id", px.block_mean(F.col("v"), W, H, 2).alias("m")), "m", "v").withColumn("v", rounded(F.col("v")))


@query
def nearest_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(views.grids(spark, sf_dir).select("id", px.nearest_resize(F.col("v"), W, H, 5, 3).alias("m")), "m", "v").withColumn("v", rounded(F.col("v")))


@query
def pack_latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = views.grids(spark, sf_dir).select("id", F.posexplode(px.packed(F.col("v"), W, H)).alias("patch", "x"))
    return packed.select("id", F.col("patch").cast("long").alias("patch"), F.posexplode("x").alias("k", "v")).select("id", "patch", F.col("k").cast("long").alias("k"), rounded(F.col("v")).alias("v"))


@query
def unpack_latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.grids(spark, sf_dir).withColumn("packed", px.packed(F.col("v"), W, H))
    return g.select("id", (px.unpacked(F.col("packed"), W, H) == F.col("v")).alias("same"))


@query
def position_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.grids(spark, sf_dir).select("id", F.posexplode(px.position_grid(W, H)).alias("p", "x"))
    return g.select("id", F.col("p").cast("long").alias("p"), F.col("x.y").cast("long").alias("y"), F.col("x.x").cast("long").alias("x"))


@query
def mask_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = masks(spark, sf_dir, 0.2).withColumn("b", px.mask_bounds(F.col("m"), W)).filter("b is not null")
    return m.select("id", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query
def mask_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks(spark, sf_dir).select("id", px.total(F.col("m").cast("array<double>")).cast("long").alias("area"))


@query
def shift_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dy = (F.col("id") % 5 - 2).cast("int"), (F.col("id") % 3 - 1).cast("int")
    return exploded(masks(spark, sf_dir).select("id", px.shifted(F.col("m"), W, H, dx, dy).alias("s")), "s", "v").withColumn("v", F.col("v").cast("long"))


@query
def mask_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_pairs(spark, sf_dir)
    fused = F.zip_with(px.binary(F.col("a"), HEAT), px.binary(F.col("b"), HEAT), lambda x, y: F.greatest(x, y))
    return exploded(g.select("id", fused.alias("m")), "m", "v").withColumn("v", F.col("v").cast("long"))


@query
def mask_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturating difference, and pixels of the first mask outside the second."""
    a, b = px.binary(F.col("a"), HEAT), px.binary(F.col("b"), HEAT)
    g = grid_pairs(spark, sf_dir).select("id", F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0))).alias("d"), F.zip_with(a, b, lambda x, y: x.bitwiseAND(1 - y)).alias("n"))
    return g.select("id", px.total(F.col("d").cast("array<double>")).cast("long").alias("left_over"), px.total(F.col("n").cast("array<double>")).cast("long").alias("outside"))


@query
def effect_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_pairs(spark, sf_dir).select("id", px.total(px.binary(F.col("a"), HEAT).cast("array<double>")).alias("o"), px.total(F.zip_with(px.binary(F.col("b"), HEAT), px.binary(F.col("a"), HEAT), lambda x, y: F.greatest(x - y, F.lit(0))).cast("array<double>")).alias("s"))
    ratio = F.when(F.col("o") > 0, F.col("s") / F.col("o")).otherwise(F.lit(0.0))
    return g.select("id", rounded(ratio).alias("ratio"), (ratio > 0.25).alias("has_effect"))


@query
def hard_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_pairs(spark, sf_dir)
    m = px.binary(F.col("a"), HEAT).cast("array<double>")
    new = F.zip_with(F.col("b"), m, lambda b, k: b * k)
    old = F.zip_with(F.col("a"), m, lambda a, k: a * (1.0 - k))
    soft = F.zip_with("a", "b", lambda a, b: px.alpha_blend(b, a, a * 4.0))
    return g.select("id", rounded(px.total(F.zip_with(new, old, lambda x, y: x + y))).alias("hard"), rounded(px.total(soft)).alias("soft"))


@query
def range_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = exploded(views.grids(spark, sf_dir), "v", "x")
    return g.select("id", "p", rounded(px.signed_range(F.col("x"))).alias("signed"), rounded(px.unit_range(F.col("x") * 3.0)).alias("unit"), px.to_byte(F.col("x")).cast("long").alias("byte"), rounded(px.normalised(F.col("x"), 0.48, 0.27)).alias("normal"))


@query
def noising(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_pairs(spark, sf_dir)
    z = F.zip_with("a", "b", lambda x, n: px.noised(x, n, 0.4))
    back = F.zip_with(z, F.zip_with("a", "b", lambda x, n: n - x), lambda y, v: px.denoised(y, v, 0.4))
    return g.select("id", rounded(px.total(z)).alias("noised"), rounded(px.total(back)).alias("restored"))


@query
def masked_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_pairs(spark, sf_dir).select(px.masked_error(F.col("a"), F.col("b"), px.binary(F.col("a"), HEAT).cast("array<double>")).alias("e"))
    return g.agg(rounded(F.avg("e")).alias("loss"))


@query
def dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_pairs(spark, sf_dir).select(px.total(F.zip_with(F.transform("a", F.abs), F.transform("b", F.abs), lambda x, y: x * y)).alias("i"), px.total(F.transform("a", F.abs)).alias("p"), px.total(F.transform("b", F.abs)).alias("t"))
    return g.agg(rounded(1 - (2 * F.sum("i") + 1) / (F.sum("p") + F.sum("t") + 1)).alias("loss"))


@query
def bce_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_pairs(spark, sf_dir).select("id", (px.total(F.zip_with("a", "b", lambda x, z: px.logit_loss(x * 5.0, F.abs(z)))) / 64.0).alias("plain"), px.masked_logit_loss(F.col("a"), F.transform("b", F.abs)).alias("weighted"))
    return g.select("id", rounded(F.col("plain")).alias("plain"), rounded(F.col("weighted")).alias("weighted"))


@query
def zip_shorter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a sample beside scores of another length, as far as both go."""
    b = views.boxes(spark, sf_dir).groupBy("sample").agg(F.sort_array(F.collect_list(F.when(F.col("kind") == "diff", F.col("pos")))).alias("d"), F.sort_array(F.collect_list(F.when(F.col("kind") != "diff", F.col("pos")))).alias("s"))
    z = b.select("sample", F.posexplode(px.zip_shorter(F.col("d"), F.col("s"))).alias("place", "z"))
    return with_new_columns(z.select("sample", F.col("place").cast("long").alias("place"), F.col("z.a").alias("a"), F.col("z.b").alias("b")), {"gap": F.col("b") - F.col("a")})


@query
def feature_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_pairs(spark, sf_dir).select("id", F.concat("a", "b").alias("x")).select("id", F.size("x").cast("long").alias("n"), rounded(F.get("x", F.lit(64))).alias("middle"))


# --- NumPy stages ---------------------------------------------------------------------------------------------------


def component_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.map_grids(masks(spark, sf_dir), "m", H, W, raster.component_rows, "found", raster.COMPONENT_DDL, raster.COMPONENT)
    return found.select("id", F.inline("found"))


@query
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_table(spark, sf_dir)


@query
def quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each mask from its components, inside the row."""
    found = raster.map_grids(masks(spark, sf_dir), "m", H, W, raster.component_rows, "found", raster.COMPONENT_DDL, raster.COMPONENT)
    areas = F.transform("found", lambda x: x["area"])
    df = found.select("id", areas.alias("areas"), F.array_max(areas).alias("most"))
    main = F.size(F.filter("areas", lambda a: a >= F.col("most") * 0.3)).cast("long")
    total = F.aggregate("areas", F.lit(0).cast("long"), lambda a, x: a + x)
    noise = F.aggregate(F.filter("areas", lambda a: a < F.col("most") * 0.3), F.lit(0).cast("long"), lambda a, x: a + x) / F.greatest(total, F.lit(1))
    reason = F.when(F.size("areas") == 0, "empty_mask").when(main > 4, "too_many_objects").when(noise > 0.3, "high_noise").otherwise("pass")
    return df.select("id", (reason == "pass").alias("is_hq"), reason.alias("reason"), F.when(reason.isin("pass", "too_many_objects"), main).otherwise(F.lit(-1).cast("long")).alias("main_count"), F.when(reason == "high_noise", F.round(noise, 3)).alias("noise_ratio"))


@query
def expand_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    grown = raster.map_grids(masks(spark, sf_dir), "m", H, W, lambda m: raster.expanded(m, 1.5).astype(int).ravel().tolist(), "e", "array<int>", pa.list_(pa.int32()))
    return exploded(grown, "e", "v").withColumn("v", F.col("v").cast("long"))


@query
def shrink_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    less = raster.map_grids(masks(spark, sf_dir, 0.0), "m", H, W, lambda m: raster.shrunk(m, 0.6).astype(int).ravel().tolist(), "e", "array<int>", pa.list_(pa.int32()))
    return exploded(less, "e", "v").withColumn("v", F.col("v").cast("long"))


@query
def open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    out = raster.map_grids(masks(spark, sf_dir, -0.1), "m", H, W, lambda m: raster.opened_closed(m, 1).astype(int).ravel().tolist(), "e", "array<int>", pa.list_(pa.int32()))
    return exploded(out, "e", "v").withColumn("v", F.col("v").cast("long"))


# --- metrics --------------------------------------------------------------------------------------------------------


@query
def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_means(metrics.checked_finite(views.metrics(spark, sf_dir))).withColumn("mean", rounded(F.col("mean")))


@query
def logged_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.alternating(metrics.logged_steps(views.metrics(spark, sf_dir), 5), 3)
    return m.groupBy("step", "turn").agg(F.count("*").alias("n"))


@query
def grad_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = views.metrics(spark, sf_dir).select(F.concat_ws(".", "metric", F.lit("weight")).alias("group"), "value").filter(F.col("group").endswith("weight"))
    return metrics.gradient_norms(values).withColumn("norm", rounded(F.col("norm"), 4))


@query
def parameter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.parameter_totals(views.table(spark, sf_dir, "part").select((F.col("p_partkey") * F.col("p_size")).alias("n"), (F.col("p_size") > 25).alias("trainable")))


@query
def mean_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", F.col("value")).alias("seconds"))
    return metrics.mean_time(items).withColumn("mean_seconds", rounded(F.col("mean_seconds")))


@query
def checkpoint_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")).alias("name"))
    return metrics.checkpoints_to_drop(names, 3)


@query
def first_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = views.table(spark, sf_dir, "events").select(F.expr("event_id div 50").alias("step"), F.col("event_id").alias("pos"))
    return metrics.first_of_step(images, 4)


# --- cells ----------------------------------------------------------------------------------------------------------


@query
def cell_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cells(spark, sf_dir).select("row", "column", cell_functions.type_name(cell_functions.type_rank(F.col("cell"))).alias("type"))


@query
def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_functions.column_types(views.cells(spark, sf_dir))


@query
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = cell_functions.column_widths(views.cells(spark, sf_dir))
    return w.select("column", F.col("width").cast("long").alias("width"), F.col("decimals").cast("long").alias("decimals"))


@query
def thousands_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cells(spark, sf_dir).select("row", "column", cell_functions.is_thousands(F.col("cell")).alias("thousands"))


@query
def decimal_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cells(spark, sf_dir).select("row", "column", cell_functions.decimals(F.col("cell")).cast("long").alias("decimals"))


@query
def padded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.cells(spark, sf_dir)
    pad = lambda side: F.concat(F.lit("|"), cell_functions.padded(F.col("cell"), F.lit(12), side), F.lit("|"))
    return c.select("row", "column", pad("left").alias("left"), pad("right").alias("right"), pad("center").alias("center"))


@query
def escaped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("<"), F.col("r_name"), F.lit("> & 100% \"a\"_{'b'}"))
    return views.table(spark, sf_dir, "region").select("r_regionkey", cell_functions.html_escaped(t).alias("html"), cell_functions.latex_escaped(F.concat(F.col("r_name"), F.lit("_50%&#"))).alias("latex"), cell_functions.rst_first(F.lit("  ")).alias("rst"))


from . import curation_queries, file_queries, picture_queries  # noqa: E402, F401 - register their queries
