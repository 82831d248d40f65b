"""How five document filters act together: what each removes in every order, what it alone catches, what it costs.

A relational word pipeline. Words are exploded and aggregated by (document, word), then by document, for totals and
distinct words; the other flags come from the text as a whole, from the texts of all smaller ids and from the labels,
and are joined to every document. A document is then one of 32 sets of failed filters: each part of the corpus needs
only 32 conditional counts, by which all 120 orders and their steps are answered without another look at documents.

Texts are dealt out once by (id, hash of the text, salt), which serves both aggregations; the salt spreads rows that
repeat an id and a text. Texts that many documents share meet only in narrow rows, whose counts are added up before they
are shuffled and whose join adaptive execution splits. Two texts are the same where length and two XXH64 values agree.

Nulls: a null text is empty, a null source is the part '', a null id is neither smaller nor larger than another and has
no label. An empty text has no words: it fails A alone (and E). Very long texts are rows of words like any others.
Repeated rows are documents of their own, and no smaller id's. Labels that repeat an id count if any row says 1. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, text_of, words_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Shares of rows that repeat an id and a text.
SALTS = 64


def _id() -> Column:
    return F.col("doc_id").cast("long").alias("doc_id")


def word_totals(docs: DataFrame) -> DataFrame:
    """doc_id, own (hash of the text), n_words and n_distinct of every different pair of id and text."""
    text = text_of()
    rows = docs.select(_id(), F.xxhash64(text).alias("own"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"), text.alias("text"))
    # the word null stands for the row itself
    words = rows.repartition("doc_id", "own", "salt").select("doc_id", "own", "salt", F.explode(F.array_append(words_of(F.col("text")), F.lit(None).cast("string"))).alias("word"))
    counted = words.groupBy("doc_id", "own", "salt", "word").agg(F.count("*").alias("n"))
    salted = counted.groupBy("doc_id", "own", "salt").agg(F.sum("n").alias("n"), F.count("word").alias("n_distinct"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("rows"))
    whole = salted.groupBy("doc_id", "own").agg(F.sum("n").alias("n"), F.max("n_distinct").alias("n_distinct"), F.sum("rows").alias("rows"))
    return whole.select("doc_id", "own", F.expr("n div rows - 1").alias("n_words"), "n_distinct")


def text_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, own, other, n_points, c and d of every document."""
    text = text_of()
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return docs.select(
        _id(),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("own"),
        F.xxhash64(F.lit(FILTERS), text).alias("other"),
        F.length(text).alias("n_points"),
        (F.lit(100).cast("long") * capitals > F.lit(5).cast("long") * F.length(text)).alias("c"),
        text.rlike("[#$%&*|]").alias("d"),
    )


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, failed (a number below 32, bit k for filter k), good and toxic of every document."""
    flags = Scratch(docs.sparkSession, "filter-audit").save(text_flags(docs), "flags")
    same = ["own", "other", "n_points"]
    shared = flags.groupBy(*same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    marks = labels.select(_id(), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).groupBy("doc_id")
    marks = marks.agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    totals = word_totals(docs).withColumnsRenamed({"doc_id": "word_id", "own": "word_own"})
    joined = flags.join(shared, same, "left").join(marks, "doc_id", "left")
    joined = joined.join(totals, F.col("doc_id").eqNullSafe(F.col("word_id")) & (F.col("own") == F.col("word_own")), "left")
    words, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    fails = [words < 50, 100 * distinct < 65 * words, F.col("c"), F.col("d"), F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))]
    number = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    return joined.select("doc_id", "part", number.alias("failed"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def interactions(found: DataFrame) -> DataFrame:
    """The audit of documents with part, failed, good and toxic: one row for each part, order and step."""
    count = lambda cond: F.array(*[F.count_if((F.col("failed") == m) & cond) for m in range(1 << len(FILTERS))])
    counts = found.groupBy("part").agg(count(F.lit(True)).alias("n"), count(F.col("good")).alias("g"), count(F.col("toxic")).alias("t"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    rows = counts.select("*", F.explode(F.split(F.lit(" ".join(ORDERS)), " ")).alias("filter_order")).select("*", steps.alias("step"))
    number = lambda letters: sum((F.contains(letters, F.lit(f)).cast("int") * (1 << k) for k, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("own", number(F.expr("substring(filter_order, step, 1)"))).withColumn("before", number(F.expr("substring(filter_order, 1, step - 1)")))
    all_orders = F.lit(factorial(len(FILTERS)))

    def added(counts: str, weight: Callable[[Column], Column]) -> Column:
        """The sum over the sets of their counts times the weight of a set."""
        return F.aggregate(F.transform(counts, lambda n, m: n * weight(m).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    return rows.select(
        "part",
        "filter_order",
        "step",
        added("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        added("n", removed).alias("removed"),
        added("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        added("n", lambda m: m == F.col("own")).alias("unique_fails"),
        added("g", removed).alias("good_lost"),
        added("t", removed).alias("toxic_lost"),
        # in all orders together each filter that a document fails is the first of them equally often
        added("n", lambda m: F.when(fails(m), all_orders / F.bit_count(m)).otherwise(0)).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(failed_sets(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


AUDIT_SQL = r"""
WITH marks AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
flags AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
  100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(words.doc_id > first, false) AS e
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id),
failed AS (SELECT part, good, toxic, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM flags),
sets AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS t FROM failed GROUP BY part, fails),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM orders, range(1, 6) u(step)),
met AS (SELECT part, filter_order, step, own, n, g, t, fails, contains(fails, own) AS here, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND before <> '' AND fails <> '' AS gone FROM steps, sets),
told AS (SELECT part, filter_order, step, any_value(own) AS own, sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN here AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN here AND NOT gone THEN g ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN here AND NOT gone THEN t ELSE 0 END)::BIGINT AS toxic_lost FROM met GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM told
"""
