"""The driver's tables seen as the inputs of the curation operators, in Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ADD, REMOVE = "Add object", "Remove object"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit triplets: a shard number, a row number in it, a category, two images (as numbers) and an instruction."""
    kind = F.when(F.col("event_type") == "signup", ADD).when(F.col("event_type") == "error", REMOVE).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select((F.col("event_id") / 100).cast("long").alias("shard"), F.col("event_id").alias("row"), kind.alias("category"), F.col("value").alias("source"), F.col("user_id").cast("double").alias("edited"), F.col("props").alias("instruction"))


EDITS = f"""edits AS (SELECT event_id // 100 AS shard, event_id AS "row", CASE event_type WHEN 'signup' THEN '{ADD}' WHEN 'error' THEN '{REMOVE}' ELSE event_type END AS category,
 value AS source, user_id::DOUBLE AS edited, props AS instruction FROM events)"""


def images(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Image files of one side: path and doc_id. Two documents share a stem; one is a jpg, the other a png. Some have a
    stem that the other side lacks."""
    shared = F.col("doc_id") % 3 != 0 if side == "bg" else F.col("doc_id") % 5 > 1
    stem = F.concat(F.when(shared, "").otherwise(f"only_{side}_"), F.format_string("%06d", F.expr("doc_id div 2")))
    path = F.concat(F.lit(f"{side}/"), stem, F.when(F.col("doc_id") % 2 == 0, ".jpg").otherwise(".png"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), "doc_id")


def images_sql(side: str) -> str:
    shared = "doc_id % 3 <> 0" if side == "bg" else "doc_id % 5 > 1"
    return f"{side} AS (SELECT '{side}/' || CASE WHEN {shared} THEN '' ELSE 'only_{side}_' END || printf('%06d', doc_id // 2) || CASE doc_id % 2 WHEN 0 THEN '.jpg' ELSE '.png' END AS path, doc_id FROM documents)"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem and prompt; some stems come twice, the later sequence number counts."""
    return table(spark, sf_dir, "labels").select(F.format_string("%06d", F.expr("doc_id div 2")).alias("stem"), F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(" of "), F.col("doc_id").cast("string")).alias("prompt"), F.col("doc_id").alias("seq"))


PROMPTS = "prompts AS (SELECT printf('%06d', doc_id // 2) AS stem, 'quality ' || quality || ' of ' || doc_id AS prompt, doc_id AS seq FROM labels)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by sample: odd lines are differences, even lines detections; pos orders the boxes of a sample."""
    x1, y1 = F.col("l_partkey") % 64, F.col("l_suppkey") % 64
    order = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample"),
        F.expr(f"row_number() over (partition by l_orderkey order by {order})").cast("long").alias("pos"),
        F.when(F.col("l_linenumber") % 2 == 1, "diff").otherwise("semantic").alias("kind"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 1 + F.col("l_quantity").cast("long")).alias("x2"),
        (y1 + 1 + 5 * F.col("l_linenumber").cast("long")).alias("y2"),
        (F.col("l_discount") * 10).alias("score"),
    )


BOXES = """boxes AS (SELECT l_orderkey AS sample, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos,
 CASE WHEN l_linenumber % 2 = 1 THEN 'diff' ELSE 'semantic' END AS kind, l_partkey % 64 AS x1, l_suppkey % 64 AS y1,
 l_partkey % 64 + 1 + l_quantity::BIGINT AS x2, l_suppkey % 64 + 1 + 5 * l_linenumber::BIGINT AS y2, l_discount * 10 AS score FROM lineitem)"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 grids in row order: id and v."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


#: Pixels of the grids: id, p (place), r, c, v.
PIXELS = "px AS (SELECT vec_id AS id, i - 1 AS p, (i - 1) // 8 AS r, (i - 1) % 8 AS c, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i))"


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), (256 + 64 * (F.col("n_chars") % 5)).alias("width"), (256 + 64 * (F.col("doc_id") % 3)).alias("height"))


RESOLUTIONS = "res AS (SELECT doc_id AS idx, 256 + 64 * (n_chars % 5) AS width, 256 + 64 * (doc_id % 3) AS height FROM documents)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.expr("event_id div 100").alias("step"), F.col("event_type").alias("metric"), "value")


METRICS = "metrics AS (SELECT event_id // 100 AS step, event_type AS metric, value FROM events)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a table as text: the row, the column and the cell."""
    part = table(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast("decimal(18,2)")
    return part.select(
        F.col("p_partkey").alias("row"),
        F.explode(
            F.map_from_arrays(
                F.array(*[F.lit(c) for c in ("key", "price", "money", "brand", "even", "gap", "small")]),
                F.array(
                    F.col("p_partkey").cast("string"),
                    price.cast("string"),
                    F.format_number(price, 2),
                    F.col("p_brand"),
                    F.when(F.col("p_partkey") % 2 == 0, "True").otherwise("False"),
                    F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.lit("")),
                    F.concat(F.col("p_size").cast("string"), F.lit("e"), (F.col("p_partkey") % 7).cast("string")),
                ),
            )
        ).alias("column", "cell"),
    )


CELLS = """cells AS (SELECT p_partkey AS "row", u.c AS "column", u.x AS cell FROM part, LATERAL (VALUES ('key', p_partkey::VARCHAR), ('price', p_retailprice::DECIMAL(18,2)::VARCHAR),
 ('money', format('{:,.2f}', p_retailprice::DECIMAL(18,2)::DOUBLE)), ('brand', p_brand), ('even', CASE WHEN p_partkey % 2 = 0 THEN 'True' ELSE 'False' END),
 ('gap', CASE WHEN p_partkey % 3 = 0 THEN p_size::VARCHAR ELSE '' END), ('small', p_size || 'e' || (p_partkey % 7))) u(c, x))"""
