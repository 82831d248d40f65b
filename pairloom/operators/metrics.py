"""Aggregates of training logs, and which checkpoints to drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metric_means(log: DataFrame) -> DataFrame:
    return log.groupBy("step", "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def checked_finite(log: DataFrame) -> DataFrame:
    """log, whose values must be finite: the first other one raises."""
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    return log.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("not finite at step "), F.col("step").cast("string"))).cast("double")).otherwise(F.col("value")))


def logged_steps(log: DataFrame, every: int) -> DataFrame:
    """The first step and every n-th."""
    return log.filter((F.col("step") % every == 0) | (F.col("step") == 1))


def alternating(log: DataFrame, accumulate: int) -> DataFrame:
    """Adds turn: 0 and 1 in turn, each for `accumulate` steps."""
    return log.withColumn("turn", F.pmod(F.floor(F.col("step") / accumulate), F.lit(2)).cast("long"))


def gradient_norms(values: DataFrame) -> DataFrame:
    """The length of all values of a group (group, value)."""
    return values.groupBy("group").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def parameter_totals(parameters: DataFrame) -> DataFrame:
    """Millions of parameters (n, trainable), all and trainable, to two decimals."""
    millions = lambda x: F.round(F.sum(x) / 1e6, 2)
    return parameters.agg(millions(F.col("n")).alias("total_m"), millions(F.when(F.col("trainable"), F.col("n")).otherwise(0)).alias("trainable_m"))


def mean_time(items: DataFrame) -> DataFrame:
    """Seconds over all listed items; items that failed have no seconds but count."""
    return items.agg((F.coalesce(F.sum("seconds"), F.lit(0.0)) / F.count("*")).alias("mean_seconds"), F.count("*").alias("n"))


def checkpoints_to_drop(names: DataFrame, limit: int) -> DataFrame:
    """name and step of the checkpoints to delete before one more is written, so that `limit` are left after it.

    Steps are compared as numbers. The newest limit - 1 are found by a top-k that never sorts the rest.
    """
    steps = names.select("name", F.regexp_extract("name", r"-(\d+)$", 1).cast("long").alias("step")).filter(F.col("step").isNotNull())
    keep = steps.orderBy(F.desc("step")).limit(limit - 1) if limit > 1 else steps.limit(0)
    return steps.join(keep.select("step"), "step", "left_anti").select("name", "step")


def first_of_step(images: DataFrame, n: int = 4) -> DataFrame:
    """The first n images of each step, and their place in a grid of four columns."""
    rank = F.row_number().over(Window.partitionBy("step").orderBy("pos")) - 1
    return images.withColumn("rank", rank.cast("long")).filter(F.col("rank") < n).withColumns({"grid_row": F.floor(F.col("rank") / 4).cast("long"), "grid_col": F.col("rank") % 4})


def sample_grid(images: DataFrame, height: int, width: int, n: int = 4, across: int = 4, pad: int = 2) -> DataFrame:
    """step, grid_height, grid_width and grid: the first n images (v, arrays in row order) of each step in one picture.

    Tiles stand `across` to a row with `pad` empty pixels around each; a single image stays as it is. A step's images
    meet in one aggregate of at most n, and each pixel of the grid looks its own up by its place.
    """
    first = first_of_step(images, n).groupBy("step").agg(F.sort_array(F.collect_list(F.struct("rank", "v"))).alias("tiles"))
    count = F.size("tiles")
    columns = F.least(count, F.lit(across))
    rows = F.ceil(count / columns).cast("int")
    alone = count == 1
    sized = first.withColumn("grid_width", F.when(alone, width).otherwise((width + pad) * columns + pad)).withColumn("grid_height", F.when(alone, height).otherwise((height + pad) * rows + pad))
    margin = F.when(alone, 0).otherwise(pad)

    def pixel(p):
        y, x = F.floor(p / F.col("grid_width")).cast("int") - margin, (p % F.col("grid_width")).cast("int") - margin
        tile = F.floor(y / (height + pad)).cast("int") * columns + F.floor(x / (width + pad)).cast("int")
        inside = (y >= 0) & (x >= 0) & (y % (height + pad) < height) & (x % (width + pad) < width) & (tile < count)
        value = F.get(F.get(F.transform("tiles", lambda t: t["v"]), tile), (y % (height + pad)) * width + x % (width + pad))
        return F.when(inside, value).otherwise(0.0)

    return sized.select("step", "grid_height", "grid_width", F.transform(F.sequence(F.lit(0), F.col("grid_height") * F.col("grid_width") - 1), pixel).alias("grid"))
