"""A sink of picture files, one for each row, that shows all files of a job or none.

    sink_pictures(spark)
    df.select("name", "data").write.format("pictures").mode("append").save(folder)

Tasks write below a hidden folder of the job, each attempt in one of its own. When all have ended well, the driver moves
the files of the attempts that they report to their places, several at a time, and marks the folder with _SUCCESS; if one
fails for good, the hidden folder goes and nothing has changed. A task that runs twice, or a lost executor, leaves no file
behind. An attempt reports the lists of its names, which it keeps beside its files; the driver holds a list at a time.
Append replaces files of the same name and keeps others; overwrite empties the folder first. Rows whose name or data is
null raise, as do names that leave the folder; of rows that repeat a name, one stays.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import file_system

#: Files that the driver moves at once, and names in a list of an attempt.
MOVERS, NAMES = 16, 4096


@dataclass
class Written(WriterCommitMessage):
    """Where an attempt wrote, and how many lists of names are beside that."""

    below: str
    lists: int


class PictureWriter(DataSourceWriter):
    def __init__(self, schema: StructType, folder: str, overwrite: bool):
        if [f.name for f in schema] != ["name", "data"]:
            raise ValueError("pictures are written from the columns name and data")
        self.folder, self.overwrite, self.job = folder.rstrip("/"), overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        on, root = file_system(self.folder)
        below, names, made = f"{self.job}/{uuid.uuid4().hex}", set(), set()
        for row in iterator:
            name = posixpath.normpath(row["name"])
            if name.startswith(("../", "/", "_temporary-")) or name in (".", ".."):
                raise ValueError(f"{row['name']} is no name of a file in the folder")
            path = f"{root}/{below}/{name}"
            if (parent := posixpath.dirname(path)) not in made:
                on.create_dir(parent, recursive=True)
                made.add(parent)
            with on.open_output_stream(path) as f:
                f.write(bytes(row["data"]))
            names.add(name)
        lists = 0
        for some in batched(sorted(names), NAMES):
            with on.open_output_stream(f"{root}/{below}-{lists}") as f:
                f.write(json.dumps(some).encode())
            lists += 1
        return Written(below, lists)

    def commit(self, messages: list[Written | None]) -> None:
        on, root = file_system(self.folder)
        on.create_dir(root, recursive=True)
        if self.overwrite:
            for entry in on.get_file_info(fs.FileSelector(root)):
                if not entry.base_name.startswith("_temporary-"):
                    (on.delete_dir if entry.type == fs.FileType.Directory else on.delete_file)(entry.path)
        with ThreadPoolExecutor(MOVERS) as pool:
            for below, k in ((f"{root}/{m.below}", k) for m in messages if m for k in range(m.lists)):
                with on.open_input_stream(f"{below}-{k}") as f:
                    names = json.loads(f.read())
                for folder in {posixpath.dirname(name) for name in names}:
                    on.create_dir(posixpath.join(root, folder), recursive=True)
                list(pool.map(on.move, (f"{below}/{n}" for n in names), (f"{root}/{n}" for n in names)))
        self._clear(on, root)
        with on.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.folder))

    def _clear(self, on: fs.FileSystem, root: str) -> None:
        if on.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            on.delete_dir(f"{root}/{self.job}")


class PictureSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pictures"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> PictureWriter:
        return PictureWriter(schema, self.options["path"], overwrite)


def sink_pictures(spark: SparkSession) -> None:
    """Makes the format `pictures` known to a session."""
    spark.dataSource.register(PictureSink)


def write_pictures(df: DataFrame, folder: str, name: str = "name", data: str = "data", mode: str = "append") -> None:
    """Writes a file for each row: name is its path below the folder."""
    sink_pictures(df.sparkSession)
    df.select(F.col(name).alias("name"), F.col(data).alias("data")).write.format("pictures").mode(mode).save(folder)
