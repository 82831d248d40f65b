"""The filter audit against SQL on the tables, and against a plain version on the edges."""

import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from pairloom.llm.filter_audit import AUDIT_SQL, failed_sets, interactions, op11_filter_audit, word_totals

SF = "/root/testdata/sf0.001"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """(part, set of failed filters) of rows (id, text, source)."""
    out = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        earlier = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows)
        flags = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), earlier)
        out.append((source or "", frozenset(f for f, x in zip("ABCDE", flags, strict=True) if x)))
    return out


def audit(found):
    """found: (part, failed, good, toxic) of every document."""
    out = {}
    for part in {p for p, *_ in found}:
        own, shapley = [x[1:] for x in found if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                redundant = sum(f in x[0] for x in own) - len(gone)
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_against_sql(spark):
    got = {tuple(r) for r in op11_filter_audit(spark, SF).select(COLUMNS).collect()}
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = set(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({AUDIT_SQL})").fetchall())
    assert got == want and len(got) % 600 == 0


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"w{k}" for k in range(60))
    return [
        (1, long, "s"), (2, long, "s"), (2, long, "s"), (3, long + " $", None), (4, None, "s"), (5, "", ""), (6, "", "t"), (None, long, "t"), (None, "", "s"),
        (7, "same " * 80, "t"), (8, "UPPER CASE " * 40, "t"), (9, "a%b", None), (10, "same\x0bsame\tsame " * 30, "s"), (11, long.replace("w1", "W1"), "t"),
        (12, "é " * 70, "s"), (13, " ".join(f"v{k % 40}" for k in range(61)), "s"), (14, " ".join(f"v{k % 40}" for k in range(62)), "s"), (15, " ".join(f"x{k}" for k in range(20000)), "t"), (-1, "a%b", "s"),
    ]


@pytest.mark.parametrize("parts", [1, 5])
def test_edges(spark, rows, parts):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n_words int, failed string").repartition(parts)
    labels = [(1, 1, 0), (1, None, None), (2, 1, 1), (8, 0, 1), (None, 1, 1), (9, None, 1), (99, 1, 1)]
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    want = [(part, failed, i in good, i in toxic) for (part, failed), (i, *_) in zip(fails(rows), rows, strict=True)]
    found = failed_sets(df, marks)
    names = lambda m: frozenset(f for k, f in enumerate("ABCDE") if m >> k & 1)
    assert sorted((r.part, sorted(names(r.failed)), r.good, r.toxic) for r in found.collect()) == sorted((p, sorted(f), g, t) for p, f, g, t in want)
    assert {tuple(r) for r in interactions(found).select(COLUMNS).collect()} == audit(want)


def test_totals_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b a")] * 500 + [(2, ""), (None, "x"), (None, "x")], "doc_id long, text string").repartition(7)
    got = {(r.doc_id, r.n_words, r.n_distinct) for r in word_totals(df).collect()}
    assert got == {(1, 3, 2), (2, 0, 0), (None, 1, 1)}


def test_empty(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions(failed_sets(empty, labels)).count() == 0
    assert failed_sets(docs, labels).agg(F.max(F.col("good") | F.col("toxic"))).first()[0] is False
