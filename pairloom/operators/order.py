"""Row numbers, prefix sums and partitions over a whole table without a single-task sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch_folder

#: Rows of a range that is numbered in one task, bounds looked through at each of two levels, and keys sampled a range.
RANGE_ROWS, SIDE, SAMPLE = 1 << 18, 64, 16


def written(df: DataFrame) -> DataFrame:
    """df as a table below the shared folder, so that what it is made of is not made again."""
    path = f"{scratch_folder(df.sparkSession, 'numbered')}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_index(df: DataFrame, key: str, *ties: str, to: str = "idx", total: str | None = None) -> DataFrame:
    """Adds 0, 1, 2 ... in the order of key (never null), then ties; total names a column for the number of rows.

    A table of one range is counted and numbered. A larger one is written once; its rows are cut into ranges of the key
    at quantiles of a hash sample, numbered in their range, and moved on by the number of rows of the ranges before. The
    ranges follow the number of rows, up to SIDE * SIDE of them; a row finds its own in two steps of at most SIDE
    comparisons, and SAMPLE keys a range are collected. Ties should make rows unique.
    """
    n = df.count()
    side = min(SIDE, max(1, math.ceil(math.sqrt(n / RANGE_ROWS))))
    if side == 1:
        numbered = df.withColumn(to, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key, *ties)) - 1).cast("long"))
        return numbered.withColumn(total, F.lit(n).cast("long")) if total else numbered
    df = written(df)
    found = sorted(r[0] for r in df.select(key).orderBy(F.xxhash64(F.col(key)), key).limit(SAMPLE * side * side).collect())
    cuts = sorted({found[i * len(found) // (side * side)] for i in range(1, side * side)})
    chunks = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col(key)))
    step = below(F.array(*[F.lit(c[0]) for c in chunks[1:]])) if len(chunks) > 1 else F.lit(0)
    place = step * side + below(F.element_at(F.array(*[F.array(*[F.lit(x) for x in c]) for c in chunks]), step + 1))
    cut = df.withColumn("__range", place)
    before = cut.groupBy("__range").agg(F.count("*").alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(key, *ties))
    numbered = cut.join(before, "__range").withColumn(to, (own - 1 + F.col("__before")).cast("long")).drop("__range", "__before")
    return numbered.withColumn(total, F.lit(n).cast("long")) if total else numbered


def positional_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, strict: bool = False) -> DataFrame:
    """Row i beside row i, in key order; the shorter side ends it, or raises if strict. Adds idx."""
    a, b = dense_index(left, left_key), dense_index(right, right_key)
    if strict and (n := left.count()) != (m := right.count()):
        raise ValueError(f"lists of different length: {n} and {m}")
    return a.join(b, "idx")


def skip_first(df: DataFrame, key: str, n: int) -> DataFrame:
    """What is left of a list in key order after its first n rows."""
    return dense_index(df, key).filter(F.col("idx") >= n).drop("idx")


def worker_of(idx: Column, total: Column, workers: int) -> Column:
    """The worker of a row in contiguous shares; the first total % workers get one more."""
    share, more = F.floor(total / workers), total % workers
    head = (share + 1) * more
    return F.when(idx < head, F.floor(idx / (share + 1))).otherwise(more + F.floor((idx - head) / F.greatest(share, F.lit(1)))).cast("long")


def worker_shares(df: DataFrame, key: str, workers: int) -> DataFrame:
    """Adds worker: balanced contiguous shares in key order."""
    numbered = dense_index(df, key, total="__total")
    return numbered.withColumn("worker", worker_of(F.col("idx"), F.col("__total"), workers)).drop("__total")


def chunked(df: DataFrame, group: list[str], order: list[str | Column], size: int, drop_last: bool, slot: Column | None = None) -> DataFrame:
    """Adds chunk and place: rows of a group (never null) cut into chunks of a size; the last short one stays or goes.

    slot: a whole number that grows with the order and has few values, each with about as many rows. Slots are numbered
    one by one and moved on by the rows of the slots before, so a group of any size is never in one task.
    """
    parts = df.withColumn("__slot", F.lit(0) if slot is None else slot)
    counts = parts.groupBy(*group, "__slot").agg(F.count("*").alias("__own"))
    w = Window.partitionBy(*group)
    before = F.sum("__own").over(w.orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__own")
    counts = counts.withColumn("__before", before).withColumn("__n", F.sum("__own").over(w)).drop("__own")
    own = F.row_number().over(Window.partitionBy(*group, "__slot").orderBy(*order)) - 1
    out = parts.withColumn("__i", own).join(counts, [*group, "__slot"]).withColumn("__i", F.col("__i") + F.col("__before"))
    out = out.withColumn("chunk", F.floor(F.col("__i") / size).cast("long")).withColumn("place", (F.col("__i") % size).cast("long"))
    if drop_last:
        out = out.filter(F.col("chunk") < F.floor(F.col("__n") / size))
    return out.drop("__i", "__slot", "__before", "__n")
