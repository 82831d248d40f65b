"""Columns of the input that are called like helper or result columns."""

from pyspark.sql import functions as F

from pairloom.llm.overlaps import keep_one_similar
from pairloom.llm.quality import base_counts, clean_lines
from pairloom.llm.simhash import keep_one

NAMES = ("copies", "__key", "__text", "__own", "__id", "__hash", "__none", "n_lines", "__lines", "clean_text", "n_words", "key", "fp", "root", "buckets", "none", "id", "own")


def test_helper_names(docs):
    df = docs.withColumns({c: F.lit(k) for k, c in enumerate(NAMES)})
    for f in (keep_one, keep_one_similar):
        got = f(df)
        assert got.columns == df.columns and got.count() == f(docs).count()
        assert all([r[c] for c in NAMES] == list(range(len(NAMES))) for r in got.collect())


def test_result_names(docs):
    df = docs.withColumns({c: F.lit(k) for k, c in enumerate(NAMES)})
    lines, counts = clean_lines(df), base_counts(df)
    assert lines.columns.count("n_lines") == 1 and counts.columns.count("n_words") == 1
    assert {(r.clean_text, r.n_lines) for r in lines.collect()} == {(r.clean_text, r.n_lines) for r in clean_lines(docs).collect()}
    assert sorted(r.n_words for r in counts.collect()) == sorted(r.n_words for r in base_counts(docs).collect())
    assert all(r["__text"] == 2 and r["__lines"] == 8 for r in lines.collect())
