"""Writers: image files, JSON maps, logs, metrics, checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.resample import resize_pictures
from ..operators.metrics import checkpoints_to_drop
from .images import with_png


def image_names(df: DataFrame, folder: str, prefix: str = "") -> DataFrame:
    """df with name: folder/<prefix><stem>.png."""
    return df.withColumn("name", F.concat(F.lit(f"{folder}/{prefix}"), F.col("stem"), F.lit(".png")))


def pair_files(pairs: DataFrame) -> DataFrame:
    """name and data of the files of pairs (stem, bg and shot as encoded pictures): bg/<stem>.png and shot/<stem>.png."""
    return _files(pairs, "bg", "bg").unionByName(_files(pairs, "shot", "shot"))


def mask_files(masks: DataFrame, mask: str = "mask") -> DataFrame:
    """name and data of masks (stem, height, width and an array of 0 and 1): masks/mask_<stem>.png in 0 and 255."""
    scaled = masks.withColumn("__data", F.transform(mask, lambda x: (x > 0).cast("int") * 255))
    return _files(with_png(scaled, "__data", 1), "masks", "png", "mask_")


def core_files(cores: DataFrame, least: float = 0.15, mask: str = "mask") -> DataFrame:
    """name and data of the masks of objects (stem, height, width, mask, ratio) whose effect is beyond a share of them."""
    found = cores.filter(F.col("ratio") > least).withColumn("__data", F.transform(mask, lambda x: (x > 0).cast("int") * 255))
    return _files(with_png(found, "__data", 1), "masks_object", "png")


def result_files(results: DataFrame, kernel: str = "bicubic") -> DataFrame:
    """name and data of results (stem, result, its height and width, to_height and to_width), brought back to their original size."""
    back = resize_pictures(results, "result", kernel, "__data", 3, as_bytes=True).select("stem", "__data", F.col("to_height").alias("height"), F.col("to_width").alias("width"))
    return _files(with_png(back, "__data", 3), "results", "png")


def _files(df: DataFrame, folder: str, data: str, prefix: str = "") -> DataFrame:
    return image_names(df, folder, prefix).select("name", F.col(data).alias("data"))


def write_map(df: DataFrame, path: str, key: str = "stem", value: str = "prompt") -> None:
    """One JSON object, an indented entry on each line in key order, as a folder of parts: put together they are the object.

    Each part is a range of keys, so no task holds the whole map; only the first and last key are known beforehand, for
    the brackets and the last entry's missing comma. Null values are empty text. Keys are different from each other.
    """
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x"))), r"^\{\"x\":(.*)\}$", 1)
    ends = df.agg(F.min(key).alias("__first"), F.max(key).alias("__last"))
    first, last = F.col(key) == F.col("__first"), F.col(key) == F.col("__last")
    entry = F.concat(F.lit("  "), quoted(F.col(key)), F.lit(": "), quoted(F.col(value)), F.when(last, "").otherwise(","))
    lines = F.concat(F.when(first, F.array(F.lit("{"))).otherwise(F.array()), F.array(entry), F.when(last, F.array(F.lit("}"))).otherwise(F.array()))
    rows = df.select(key, value).join(F.broadcast(ends)).select(key, lines.alias("lines")).orderBy(key).select(F.explode("lines").alias("value"))
    rows = df.sparkSession.createDataFrame([("{}",)], "value string") if df.isEmpty() else rows
    rows.write.mode("overwrite").text(path)


def write_log(results: DataFrame, path: str) -> None:
    """Results by worker."""
    results.write.mode("overwrite").partitionBy("worker").json(path)


def append_metrics(log: DataFrame, path: str) -> None:
    log.select("step", "metric", "value").write.mode("append").parquet(path)


def write_separated(df: DataFrame, path: str, separator: str = "\t") -> None:
    df.write.mode("overwrite").option("header", True).csv(path, sep=separator)


def save_checkpoint(df: DataFrame, folder: str, step: int, limit: int | None = None, before: Callable[[], None] | None = None) -> str:
    """Writes df as checkpoint-<step>; before that the oldest go, so that at most `limit` are left after it."""
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if before:
        before()
    if limit and fs.exists(root):
        names = [(s.getPath().getName(),) for s in fs.listStatus(root) if s.getPath().getName().startswith("checkpoint-")]
        for row in checkpoints_to_drop(spark.createDataFrame(names, "name string"), limit).collect():
            fs.delete(jvm.Path(f"{folder}/{row.name}"), True)
    path = f"{folder}/checkpoint-{step}"
    df.write.mode("overwrite").parquet(path)
    return path


def latest_step(spark, folder: str) -> int | None:
    """The highest step that has a checkpoint, to go on from."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    steps = [s.getPath().getName().rpartition("-")[2] for s in fs.listStatus(root)] if fs.exists(root) else []
    return max((int(s) for s in steps if s.isdigit()), default=None)
