"""Files that executors read and write by themselves, on any file system that Arrow knows by its URI."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that a listing hands on at once.
LISTED = 8192


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it. Unknown schemes raise."""
    found = re.match(r"(\w[\w+.-]*):/(?!/)(.*)", uri)
    uri = f"{found[1]}:///{found[2]}" if found else uri
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a file, and the file on it; its name is taken as it is, also where the folder is a URI."""
    folder, _, name = path.rpartition("/")
    on, root = file_system(folder)
    return on, f"{root}/{name}"


def names_below(folder: str, missing_ok: bool = False) -> Iterator[str]:
    """The names of a folder's own files, hidden ones left out. Local folders are walked; other systems list one at once."""
    on, root = file_system(folder)
    if not isinstance(on, fs.LocalFileSystem):
        found = on.get_file_info(fs.FileSelector(root, allow_not_found=missing_ok))
        yield from (x.base_name for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))
    elif not missing_ok or os.path.isdir(root):
        with os.scandir(root) as found:
            yield from (x.name for x in found if x.is_file() and not x.name.startswith((".", "_")))


def files_below(spark: SparkSession, folders: list[str], missing_ok: bool = False) -> DataFrame:
    """path of the files of folders, dealt to as many tasks as shuffles have.

    Folders are listed in tasks, which hand names on as they find them: the driver holds no list of files, and no task
    of Spark is planned for a few of them. A folder that is not there raises, or has no files if missing_ok.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in (f for batch in batches for f in batch.column("folder").to_pylist()):
            for names in batched(names_below(folder, missing_ok), LISTED):
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{n}" for n in names], pa.string())], names=["path"])

    found = spark.createDataFrame([(f,) for f in folders], "folder string").mapInArrow(run, "path string")
    return found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("path"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session of one process may use a local one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="pairloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted when the driver ends."""
    import uuid

    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    on = path.getFileSystem(spark._jsc.hadoopConfiguration())
    on.mkdirs(path)
    on.deleteOnExit(path)
    return folder
