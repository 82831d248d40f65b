"""Image folders: listing, decoding, sizes, and PNG writing without an imaging library."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .files import files_below, located

PNG = b"\x89PNG\r\n\x1a\n"
#: Channels of a PNG by its colour type, and those that are read of them.
PNG_CHANNELS = {0: (1, 1), 2: (3, 3), 4: (2, 1), 6: (4, 4)}
#: Bytes of pictures that a reader hands on at once.
READ = 1 << 24
#: Extensions read, all small or all capital letters.
EXTENSIONS = (".jpg", ".jpeg", ".png")
FALLBACK = 512


def images_below(spark: SparkSession, *folders: str, missing_ok: bool = False) -> DataFrame:
    """path of the images of folders, in no order, listed by tasks and dealt to all; contents are not read."""
    names = [x for e in EXTENSIONS for x in (e, e.upper())]
    return files_below(spark, list(folders), missing_ok).filter(F.regexp_extract("path", r"(\.[^./]*)$", 1).isin(names))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """path of the images of a folder, in order; contents are not read."""
    return images_below(spark, folder).orderBy("path")


def glob_images(spark: SparkSession, path: str) -> DataFrame:
    """path of one image, or of all jpg, jpeg and png files of a folder, letters of either size mixed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[jpJP][pnPN]*[gG]").load(path).select("path").orderBy("path")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, height, width, channels and data; files that are no image have height -1.

    Spark's reader knows many kinds, but lists all files in the driver and plans a task for 32 of them: read_pngs is for
    folders of many files.
    """
    image = spark.read.format("image").option("dropInvalid", False).load(folder)
    return image.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """The reader's rows, blue first, as red, green, blue; one channel is repeated, transparency dropped."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    x = rgb(data, height, width, channels).astype(float)
    return np.rint(x @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def same_shape(a: Column, b: Column) -> Column:
    return (a["height"] == b["height"]) & (a["width"] == b["width"])


def png(image: np.ndarray) -> bytes:
    """8-bit gray (height, width) or RGB (height, width, 3) as a PNG file."""
    height, width = image.shape[:2]
    kind = 0 if image.ndim == 2 else 2
    rows = np.column_stack([np.zeros(height, np.uint8), image.astype(np.uint8).reshape(height, -1)])

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _unfiltered(rows: np.ndarray, bpp: int) -> np.ndarray:
    """The bytes of a PNG's rows, each of which begins with the number of its filter."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1), np.uint8)
    for k, row in enumerate(rows, 1):
        kind, x, above = int(row[0]), row[1:], out[k - 1]
        if kind == 0:
            out[k] = x
        elif kind == 1:
            out[k] = np.cumsum(x.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[k] = x + above
        elif kind in (3, 4):
            mine, up = [0] * bpp, [0] * bpp + above.tolist()
            for i, v in enumerate(x.tolist()):
                a, b, c = mine[i], up[i + bpp], up[i]
                if kind == 4:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                else:
                    guess = (a + b) // 2
                mine.append((v + guess) & 255)
            out[k] = mine[bpp:]
        else:
            raise ValueError(f"a PNG has no filter {kind}")
    return out[1:]


def from_png(data: bytes) -> np.ndarray | None:
    """The picture (height, width, channels) of a PNG, blue first as Spark's reader has it; None if data is none.

    PNGs of 8 bits a channel, in rows from top to bottom, without a palette or a transparent colour; others raise.
    """
    if data[:8] != PNG or data[12:16] != b"IHDR" or len(data) < 33:
        return None
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    at, body, transparent = 33, [], False
    while at + 8 <= len(data):
        n, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if name == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        transparent |= name == b"tRNS"
        at += n + 12
    if depth != 8 or kind not in PNG_CHANNELS or interlaced or transparent:
        raise ValueError("only PNGs of 8 bits, without a palette, a transparent colour or interlacing are read here")
    have, taken = PNG_CHANNELS[kind]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error:
        return None
    if min(width, height) < 1 or len(raw) != height * (1 + width * have):
        return None
    x = _unfiltered(np.frombuffer(raw, np.uint8).reshape(height, -1), have).reshape(height, width, have)[..., :taken]
    return x[..., [2, 1, 0, 3][:taken]] if taken > 1 else x


def read_pngs(paths: DataFrame) -> DataFrame:
    """path, height, width, channels and data of PNG files, opened by tasks; files that are no picture have height -1."""
    out = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path in batch.column("path").to_pylist():
                on, file = located(path)
                with on.open_input_stream(file) as f:
                    x = from_png(f.read())
                rows.append((path, -1, -1, -1, b"") if x is None else (path, *x.shape, x.tobytes()))
                size += len(rows[-1][4])
                if size >= READ:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return paths.select("path").mapInArrow(run, "path string, height int, width int, channels int, data binary")


def with_png(df: DataFrame, pixels: str, channels: int, to: str = "png") -> DataFrame:
    """Adds PNG files of the pictures in a column (arrays in row order, with height and width); null stays null."""
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c != to])

    def run(batches):
        for batch in batches:
            out = []
            for x, h, w in zip(batch.column(pixels), *(batch.column(c).to_pylist() for c in ("height", "width")), strict=True):
                picture = x.values.to_numpy(zero_copy_only=False).astype(np.uint8).reshape(h, w, channels) if x.is_valid else None
                out.append(None if picture is None else png(picture[..., 0] if channels == 1 else picture))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, to])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField(to, BinaryType())]))


def picture_sums(images: DataFrame) -> DataFrame:
    """path, height, width, channels, total (the sum of all bytes in red, green, blue order) and placed (each times its place, from 1)."""
    sums = "path string, height int, width int, channels int, total long, placed long"

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
                x = (x if r["channels"] == 1 else x[:, :, 2::-1]).ravel().astype(np.int64)
                out.append((int(x.sum()), int((x * np.arange(1, len(x) + 1)).sum())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "height", "width", "channels")), *(pa.array([o[k] for o in out], pa.int64()) for k in (0, 1))], names=["path", "height", "width", "channels", "total", "placed"])

    return images.filter("height > 0").mapInArrow(run, sums)
