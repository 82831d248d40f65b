"""What the operators share: scratch tables in the shared folder, word splitting, Arrow helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word contract: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a single-process session may fall back to a local folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="pairloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return shared_dir(spark)


class Scratch:
    """Tables written under the shared folder: lineage ends there, and a lost executor costs no recomputation.

    Results read them lazily, so they stay as long as the driver runs and are deleted when it ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df once; the schema is kept, so nothing is inferred when it is read."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        root, fs = self._at(self.root)
        fs.deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(path)

    def _at(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, name: str) -> None:
        path, fs = self._at(f"{self.root}/{name}")
        fs.delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of `names` that df does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        found = f"__{name}"
        while found.lower() in taken:
            found = f"_{found}"
        taken.add(found.lower())
        out.append(found)
    return out


def text_of(name: str = "text") -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array, by JVM functions only."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def held_out(doc_id: str, folds: int) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as an empty text and is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_arrow(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Maps Arrow batches; start() runs once in each task and returns the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of a piece hold about `most` bytes; a single longer text stays whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; asked for in the process that reads it."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
