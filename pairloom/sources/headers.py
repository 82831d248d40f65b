"""The size of a picture from its file's header: a few ranges of bytes are read, nothing is decoded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .files import located
from .images import FALLBACK, PNG, images_below

#: JPEG markers, fixed values: those that start a frame, and those that stand without a length.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
BARE = frozenset({0x01, *range(0xD0, 0xD8)})
#: Markers after which no frame can start.
LAST = frozenset({0xD9, 0xDA})

Read = Callable[[int, int], bytes]


def _png_size(read: Read) -> tuple[int, int] | None:
    chunk = read(8, 16)
    return (int.from_bytes(chunk[8:12], "big"), int.from_bytes(chunk[12:], "big")) if len(chunk) == 16 and chunk[4:8] == b"IHDR" else None


def _jpeg_size(read: Read) -> tuple[int, int] | None:
    """Walks from marker to marker, over the segments between them, to the first frame."""
    at = 2
    while True:
        head = read(at, 9)
        if len(head) < 2 or head[0] != 0xFF:
            return None
        marker = head[1]
        if marker == 0xFF:  # fills up
            at += 1
        elif marker in BARE:
            at += 2
        elif marker in LAST or len(head) < 4:
            return None
        elif marker in FRAMES:
            return (int.from_bytes(head[7:9], "big"), int.from_bytes(head[5:7], "big")) if len(head) == 9 else None
        else:
            length = int.from_bytes(head[2:4], "big")
            if length < 2:
                return None
            at += 2 + length


def picture_size(read: Read) -> tuple[int, int] | None:
    """(width, height) of the PNG or JPEG whose bytes read(at, n) gives; None for anything else."""
    start = read(0, 8)
    found = _png_size(read) if start == PNG else _jpeg_size(read) if start[:2] == b"\xff\xd8" else None
    return found if found and min(found) > 0 else None


def _with_sizes(df: DataFrame, column: str, reader: Callable[[object], tuple[int, int] | None]) -> DataFrame:
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("width", "height")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(x is not None and reader(x)) or (FALLBACK, FALLBACK) for x in batch.column(column).to_pylist()]
            sides = [pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *sides], names=[*batch.schema.names, "width", "height"])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("width", IntegerType()), StructField("height", IntegerType())]))


def header_sizes(df: DataFrame, data: str = "content") -> DataFrame:
    """df with width and height by the headers in a binary column; broken and null ones count as 512 x 512."""
    return _with_sizes(df, data, lambda x: picture_size(lambda at, n: x[at : at + n]))


def _size_of_file(uri: str) -> tuple[int, int] | None:
    on, path = located(uri)
    try:
        with on.open_input_file(path) as f:
            return picture_size(lambda at, n: f.read_at(n, at))
    except OSError:
        return None


def probed_sizes(paths: DataFrame) -> DataFrame:
    """df of path with width and height by ranges of the files; unreadable ones count as 512 x 512."""
    return _with_sizes(paths, "path", _size_of_file)


def probe_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, width and height of the pictures of a folder."""
    # sorted paths are so small that they would meet in one task or a few, which then opens all files
    return probed_sizes(images_below(spark, folder))
