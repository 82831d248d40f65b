"""Quality rules, line first: lines that break a rule go, and documents that lose too much text are rejected.

Built-in functions only. A line is removed when it is
  navigation   (many separator marks between short labels),
  boilerplate  (a stock phrase of a site's frame),
  marked up    (many symbol characters for its length),
  shouting     (many doubled exclamation or question marks, or capitals only),
  unpunctuated (few words and no sentence mark at its end),
  stuttering   (a line of moderate length of which half the words are earlier words of it),
  repeated     (equal to an earlier line, white space at its ends aside).
A document is rejected when less than `least_kept` of its characters stay, or no line stays.

Nulls count as empty texts; empty texts and texts without a word are rejected; very long texts are rows like any
other; an empty table gives an empty result; repeated rows give repeated
results; columns beside the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, documents, fresh, text_of, words_of

SYMBOLS = "[#*$%&|<>]+"
BARS = "[|»›•·]+"
#: Stock phrases of page frames; fixed values.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "skip to main content",
    "enable javascript",
    "lorem ipsum",
)
#: Longer lines are prose, whatever phrase they hold.
FRAME_CHARS = 200
SENTENCE_END = r"[.!?…:;。！？][\"'”’»)\]]*$"


def _marks(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, marks, ""))


def _fewer(text: Column, pair: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(pair), F.lit(pair[0])))


def _line_fails(line: Column) -> Column:
    """The conditions that settle most lines come first; each is evaluated only if those before it are false."""
    n = F.length(line)
    words = n - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    lower = F.lower(line)
    labels = F.split(lower, " ")
    return (
        (_marks(line, SYMBOLS) * 25 > n)
        | (_marks(line, BARS) >= F.greatest(F.lit(3), words / 5))
        | ((_fewer(line, "!!") + _fewer(line, "??")) * 10 > F.greatest(F.lit(9), words * 3))
        | ((n >= 20) & (F.upper(line) == line) & (lower != line))
        | ((n < 40) & (words < 4) & ~line.rlike(SENTENCE_END))
        | ((n <= FRAME_CHARS) & lower.rlike("|".join(BOILERPLATE)))
        | ((n <= 2 * FRAME_CHARS) & (words >= 8) & (F.size(F.array_distinct(labels)) * 2 <= F.size(labels)))
    )


CLEANED = ("clean_text", "n_lines", "n_lines_removed", "kept_share", "clean_kept")
COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _beside(docs: DataFrame, results: tuple[str, ...], text: str) -> list[Column]:
    """The columns of docs that keep their place beside results: the text, and those of other names."""
    return [F.col(f"`{c}`") for c in docs.columns if c == text or c not in results]


def clean_lines(docs: DataFrame, text: str = "text", least_kept: float = 0.5) -> DataFrame:
    """Adds clean_text, n_lines (with a word), n_lines_removed, kept_share and clean_kept to docs, in place of columns of these names."""
    kept = _beside(docs, CLEANED, text)
    raw, good, cleaned, share = fresh(docs, "lines", "good", "cleaned", "share")
    # of equal lines the first one stays
    df = docs.withColumn(raw, F.filter(F.transform(F.split(text_of(text), "\n"), lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != ""))
    df = df.withColumn(good, F.filter(F.array_distinct(raw), lambda x: ~_line_fails(x)))
    df = df.withColumn(cleaned, F.array_join(good, "\n"))
    # one mark between two lines
    total = F.length(F.array_join(raw, "\n"))
    df = df.withColumn(share, F.when(total > 0, F.length(cleaned) / total).otherwise(F.lit(0.0)))
    return df.select(
        *kept,
        F.col(cleaned).alias("clean_text"),
        F.size(raw).cast("long").alias("n_lines"),
        (F.size(raw) - F.size(good)).cast("long").alias("n_lines_removed"),
        F.col(share).alias("kept_share"),
        ((F.col(share) > 0) & (F.col(share) >= least_kept)).alias("clean_kept"),
    )


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to docs, in place of columns of these names.

    A word repeats if a window of five words that holds it is found twice or more in the text. Windows are
    compared by a 64-bit hash of their five words.
    """
    kept = _beside(docs, COUNTED, text)
    words, n, windows, ordered, found, repeats = fresh(docs, "words", "n", "windows", "sorted", "lines", "repeat")
    whole = text_of(text)
    df = docs.withColumn(words, words_of(whole)).withColumn(n, F.size(words))
    after = lambda i, k: F.get(words, i + k)
    starts = F.transform(words, lambda x, i: F.xxhash64(x, after(i, 1), after(i, 2), after(i, 3), after(i, 4)))
    df = df.withColumn(windows, F.when(F.col(n) >= 5, F.slice(starts, F.lit(1), F.col(n) - 4)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(ordered, F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda j, k: F.get(ordered, k)["h"].eqNullSafe(F.get(ordered, j)["h"])
    at = F.sort_array(F.transform(F.filter(F.transform(ordered, lambda x, j: F.struct(x["i"].alias("i"), (same(j, j - 1) | same(j, j + 1)).alias("same"))), lambda x: x["same"]), lambda x: x["i"]))
    # the windows that repeat, in order: each adds what the one before it has not covered
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumn(found, lines).withColumn(repeats, F.coalesce(covered, F.lit(0)).cast("long"))
    return df.select(
        *kept,
        F.col(n).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _marks(whole, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        F.col(repeats).alias("n_repeat_words"),
        ((F.col(n) < 10) | (100 * F.col(repeats) > 20 * F.col(n))).alias("base_failed"),
    )


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts, the line cleaning and the verdict of every document, with its cleaned text."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    df = clean_lines(base_counts(slim))
    return df.drop("text").withColumn("kept", ~F.col("base_failed") & F.col("clean_kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_rules(documents(spark, sf_dir))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "kept_share")


#: op9_quality_rules in DuckDB's SQL.
QUALITY_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
step AS (SELECT doc_id, least(5, i - lag(i, 1, -5) OVER (PARTITION BY doc_id ORDER BY i)) AS n FROM d),
r AS (SELECT doc_id, sum(n)::BIGINT AS n_repeat_words FROM step GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM t),
lt AS (SELECT doc_id, raw, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
ln AS (SELECT doc_id, raw, line, length(line) AS n, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM lt WHERE line <> ''),
bad AS (SELECT *, (n - length(regexp_replace(line, '{SYMBOLS}', '', 'g'))) * 25 > n
 OR n - length(regexp_replace(line, '{BARS}', '', 'g')) >= greatest(3, words / 5)
 OR (2 * n - length(replace(line, '!!', '!')) - length(replace(line, '??', '?'))) * 10 > greatest(9, words * 3)
 OR (n >= 20 AND upper(line) = line AND lower(line) <> line)
 OR (n < 40 AND words < 4 AND NOT regexp_matches(line, '{SENTENCE_END.replace(chr(39), 2 * chr(39))}'))
 OR (n <= {FRAME_CHARS} AND regexp_matches(lower(line), '{"|".join(BOILERPLATE)}'))
 OR (n <= {2 * FRAME_CHARS} AND words >= 8 AND len(list_distinct(string_split(lower(line), ' '))) * 2 <= len(string_split(lower(line), ' '))) AS bad FROM ln),
good AS (SELECT doc_id, count(*) AS n, sum(n) + count(*) - 1 AS chars FROM (SELECT DISTINCT doc_id, line, n FROM bad WHERE NOT bad) GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n_lines, sum(n) + count(*) - 1 AS chars, count(*) - count(DISTINCT raw) AS n_dup_lines FROM ln GROUP BY doc_id),
b AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
 coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_lines - coalesce(good.n, 0), 0)::BIGINT AS n_lines_removed,
 CASE WHEN a.chars > 0 THEN coalesce(good.chars, 0)::DOUBLE / a.chars ELSE 0.0 END AS kept_share
 FROM w LEFT JOIN r USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN good USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND kept_share > 0 AND kept_share >= 0.5 AS kept FROM f
"""
