"""Tables from text files, maps, driver-side values and databases."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: White space at the ends of a line.
BLANK = " \t\n\x0b\x0c\r"


def read_map(spark: SparkSession, path: str, key: str = "stem", value: str = "prompt") -> DataFrame:
    """key and value of a JSON object of strings; a missing file is an empty map.

    A file that has an entry on each line, or a folder of such parts (sinks.write_map), is read line by line by many tasks;
    an object on one line, or laid out in another way, is read whole.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{key} string, {value} string")
    lines = spark.read.text(path).select(F.btrim("value", F.lit(BLANK)).alias("value")).filter("value not in ('', '{', '}')")
    entry = F.from_json(F.concat(F.lit("{"), F.regexp_replace("value", ",$", ""), F.lit("}")), "map<string,string>")
    if lines.filter(~F.col("value").startswith('"') | entry.isNull()).isEmpty():
        return lines.select(F.explode(entry).alias(key, value))
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def numbered_lines(spark: SparkSession, lists: Mapping[str, str]) -> DataFrame:
    """list, idx (0, 1, 2 ... in file order) and line (stripped) of text files, blank lines left out.

    A list is a file, or a folder of parts in the order of their names. Lines are counted by the blocks they are read in,
    and a block's numbers go on where the blocks before it end: one pass to count, one to number, nothing is sorted.
    """
    rows = None
    for name, path in lists.items():
        text = spark.read.text(path).select(F.lit(name).alias("list"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.btrim("value", F.lit(BLANK)).alias("line"))
        rows = text if rows is None else rows.unionByName(text)
    rows = rows.filter("line <> ''").withColumn("at", F.monotonically_increasing_id())
    blocks = rows.groupBy("list", "file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("list").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("start", before - F.col("first")).drop("n", "first")
    return rows.join(starts, ["list", "file", "block"]).select("list", (F.col("at") + F.col("start")).alias("idx"), "line")


def below(path: Column, root: str) -> Column:
    """A path as it is if it is absolute, else below root."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def read_manifest(spark: SparkSession, path: str, root: str) -> DataFrame:
    """line (0, 1, 2 ... in file order) and path of a list of files; blank lines are skipped, relative paths are below root."""
    return numbered_lines(spark, {"all": path}).select(F.col("idx").alias("line"), below(F.col("line"), root).alias("path"))


def zip_manifests(spark: SparkSession, lists: Mapping[str, str], root: str) -> DataFrame:
    """idx and a path for each list, line by line; lists of different length raise when the rows are read."""
    wide = numbered_lines(spark, lists).groupBy("idx").agg(*[F.max(F.when(F.col("list") == name, below(F.col("line"), root))).alias(name) for name in lists])
    short = F.concat_ws(", ", *[F.when(F.col(f"`{name}`").isNull(), F.lit(name)) for name in lists])
    return wide.filter(F.when(short != "", F.raise_error(F.concat(F.lit("lists of different length: no line "), F.col("idx").cast("string"), F.lit(" in "), short)).cast("boolean")).otherwise(True))


def key_columns(rows: DataFrame, order: str, json: str, missing: str | None = None, most: int = 4096) -> DataFrame:
    """order and a VARIANT column for each key that any row's JSON object has, in the order in which keys are first seen.

    missing: JSON text for rows without a key, else they are null. Objects that can't be parsed have no keys. Names are
    found by an aggregate; more than `most` of them raise, as a table can't have that many columns.
    """
    keys = rows.select(order, F.posexplode(F.json_object_keys(json)).alias("at", "key")).groupBy("key").agg(F.min(F.struct(order, "at")).alias("first"))
    found = [r.key for r in keys.orderBy("first").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} different keys")
    # whole paths can't hold every key; a map of variants can
    parsed = rows.select(order, F.from_json(json, "map<string,variant>").alias("__row"))
    other = F.lit(None) if missing is None else F.parse_json(F.lit(missing))
    return parsed.select(order, *[F.coalesce(F.try_element_at("__row", F.lit(key)), other).alias(key) for key in found])


def read_delimited(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """parts: the cells of each line, cut at a regular expression; blank lines are dropped."""
    line = F.rtrim("value", F.lit(BLANK))
    return spark.read.text(path).select(line.alias("value")).filter("value <> ''").select(F.split("value", separator).alias("parts"))


def read_config(path: str) -> dict:
    """A YAML file, if the YAML library is there; else flat `key: value` lines."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return {k.strip(): v.strip() for k, v in (line.split(":", 1) for line in text.splitlines() if ":" in line and not line.lstrip().startswith("#"))}
    return yaml.safe_load(text)


def write_cache(df: DataFrame, path: str) -> None:
    """Writes a one-row table (an embedding cache); another number of rows raises."""
    if len(df.limit(2).collect()) != 1:
        raise ValueError("a cache holds one row")
    df.write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A one-row table (an embedding cache), to be broadcast; more rows raise."""
    df = spark.read.parquet(path)
    if len(df.limit(2).collect()) != 1:
        raise ValueError(f"{path} must hold one row")
    return F.broadcast(df)


def clean_key(key: Column, prefixes: Sequence[str] = ("module.",)) -> Column:
    """A weight's name without wrapper prefixes, wherever they stand."""
    return F.regexp_replace(key, "|".join(map(re.escape, prefixes)), "")


def read_database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query's rows; headers come from the database."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def ingest(spark: SparkSession, data, headers: Sequence[str] | str | Mapping = (), missing: str = "") -> DataFrame:
    """A table of text cells from rows, columns, mappings, named tuples, dataclasses, arrays, pandas or a cursor.

    headers: names (too few name the last columns), a mapping that renames keys, "keys" or "firstrow".
    Cells keep their text; nulls stay null. The driver holds such data already; it is not collected from anywhere.
    """
    names, rows = _rows(data)
    if headers == "firstrow":
        names, rows = [str(x) for x in rows[0]] if rows else [], rows[1:]
    elif isinstance(headers, Mapping):
        names = [str(headers.get(n, n)) for n in names]
    elif headers and headers != "keys":
        names = list(headers)
    width = max([len(names), *map(len, rows)], default=0)
    names = [""] * (width - len(names)) + list(names)
    seen: dict[str, int] = {}
    unique = []
    for k, n in enumerate(names):
        n = n or f"_{k}"
        seen[n] = seen.get(n, 0) + 1
        unique.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    cells = [tuple(None if x is None else x.decode("utf-8", "ignore") if isinstance(x, bytes) else str(x) for x in [*r, *[None] * (width - len(r))]) for r in rows]
    return spark.createDataFrame(cells, ", ".join(f"`{n}` string" for n in unique) or "`_0` string")


def _rows(data) -> tuple[list[str], list[list]]:
    if hasattr(data, "columns") and hasattr(data, "values"):  # pandas
        return [str(c) for c in data.columns], data.values.tolist()
    if isinstance(data, Mapping):
        columns = [list(v) for v in data.values()]
        n = max(map(len, columns), default=0)
        return [str(k) for k in data], [[c[i] if i < len(c) else None for c in columns] for i in range(n)]
    if hasattr(data, "description") and hasattr(data, "fetchall"):  # a database cursor
        return [d[0] for d in data.description], [list(r) for r in data.fetchall()]
    if getattr(getattr(data, "dtype", None), "names", None):  # a record array
        return list(data.dtype.names), [list(r) for r in data.tolist()]
    rows = list(data)
    if not rows:
        return [], []
    first = rows[0]
    if isinstance(first, Mapping):
        names: dict[str, None] = {}
        for r in rows:
            names.update(dict.fromkeys(map(str, r)))
        return list(names), [[r.get(n) for n in names] for r in rows]
    if dataclasses.is_dataclass(first):
        fields = [f.name for f in dataclasses.fields(first)]
        return fields, [[getattr(r, f) for f in fields] for r in rows]
    if hasattr(first, "_fields"):
        return list(first._fields), [list(r) for r in rows]
    return [], [list(r) if isinstance(r, (list, tuple)) or hasattr(r, "__iter__") and not isinstance(r, (str, bytes)) else [r] for r in rows]
