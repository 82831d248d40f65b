"""Shards as they arrive: an extension beyond the batch operators.

File-source streams read new shards once each; stateless projections and counts by shard follow. Checkpoints and
output must lie in folders that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.pairs import ADD, REMOVE


def arriving(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def oriented(edits: DataFrame) -> DataFrame:
    """Additions and removals with the picture without the object first; ids need a whole pass and are given later."""
    adds = F.col("category") == ADD
    rows = edits.filter(F.col("category").isin(ADD, REMOVE))
    return rows.withColumns({"bg": F.when(adds, F.col("source")).otherwise(F.col("edited")), "shot": F.when(adds, F.col("edited")).otherwise(F.col("source"))})


def category_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts by window and category; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "category").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "category", "n")


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, once, as Parquet; started again it goes on from where it stopped."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
