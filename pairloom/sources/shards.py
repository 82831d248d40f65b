"""Parquet shards of edit triplets, named data-00007-of-00037.parquet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shards kept out of training; fixed values.
HELD_OUT = (10, 24, 30, 31)


def shard_name(shard: int, total: int) -> str:
    return f"data-{shard:05d}-of-{total:05d}.parquet"


def shard_id(path: Column) -> Column:
    """The number between the first two dashes of a file name."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^[^-]*-(\d+)", 1).try_cast("int")


def list_shards(spark: SparkSession, folder: str, excluded: Iterable[int] = ()) -> list[str]:
    """Paths of the shards of a folder in name order, without excluded ones, which are never opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName() for f in files if f.getPath().getName().endswith(".parquet"))
    out = set(excluded)
    number = lambda n: int(n.split("-")[1]) if n.count("-") and n.split("-")[1].isdigit() else -1
    return [f"{folder}/{n}" for n in names if number(n) not in out]


def read_shards(spark: SparkSession, folder: str, excluded: Iterable[int] = ()) -> DataFrame:
    """All rows of the shards left, with shard and row (the place in its file, by scan order)."""
    paths = list_shards(spark, folder, excluded)
    if not paths:
        raise FileNotFoundError(f"no shards in {folder}")
    df = spark.read.parquet(*paths)
    return df.select("*", shard_id(F.col("_metadata.file_path")).alias("shard"), F.col("_metadata.row_index").alias("row"))


def read_shard(spark: SparkSession, folder: str, shard: int, total: int) -> DataFrame:
    """One shard; a missing one raises."""
    return spark.read.parquet(f"{folder}/{shard_name(shard, total)}")


def category_counts(spark: SparkSession, folder: str, excluded: Iterable[int] = ()) -> DataFrame:
    """Counts by shard and category from that one column."""
    return read_shards(spark, folder, excluded).groupBy("shard", "category").agg(F.count("*").alias("n"))
