"""The join of similar texts against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import ngram_join
from pairloom.llm.common import documents
from pairloom.llm.ngram_join import Orders, enough, histogram, most_shared, op12_ngram_join, shingles, similar_texts

from .conftest import TEXTS

SF = "/root/testdata/sf0.001"


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else {tuple(words)} if words else set()


def brute(rows, least=80, width=5):
    """(id, size of the set, smallest id of the component) of rows (id, text)."""
    sets = [shingle_set(t, width) for _, t in rows]
    label = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if label[a] != label[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            label = [label[a] if x == label[b] else x for x in label]
    ids = lambda x: [i for (i, _), y in zip(rows, label, strict=True) if x == y and i is not None]
    return sorted(((i, len(s), min(ids(x), default=None)) for (i, _), s, x in zip(rows, sets, label, strict=True)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_on_the_table(spark):
    rows = [tuple(r) for r in documents(spark, SF).select("doc_id", "text").collect()]
    found = got(op12_ngram_join(spark, SF))
    assert found == brute(rows) and len({c for *_, c in found}) < len(found)


def edited(r, words, n):
    words = list(words)
    for at in r.sample(range(len(words)), n):
        words[at] = f"e{r.randint(0, 10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    """Copies near the threshold on both sides, a large group around a text and one without its centre, a passage that
    many texts share, parts of texts, and the edges."""
    r = random.Random(3)
    text = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    out = []
    for n in (5, 8, 20, 60, 200, 700):
        for _ in range(6):
            own = text(n)
            out.append(" ".join(own))
            out += [edited(r, own, k) for k in range(1, max(2, n // 40) + 1)]
            out += [" ".join(own[: n * k // 100]) for k in (78, 80, 82, 90)]
    centre, other, passage = text(150), text(150), text(60)
    out += [" ".join(centre), *(edited(r, centre, r.randint(1, 4)) for _ in range(60)), *(edited(r, other, r.randint(1, 4)) for _ in range(60))]
    out += [" ".join(text(r.randint(4, 40)) + passage + text(r.randint(4, 40))) for _ in range(60)]
    out += [" ".join(passage + text(k)) for k in (1, 2, 3, 4, 5, 6, 7)]
    out += [out[0]] * 20 + ["One two", "one TWO", "one two three", " \t\x0b", "É é É é É", "é é é é é"]
    out = list(enumerate(out, 100))
    r.shuffle(out)
    return [*out, *TEXTS, (100, "another text of the same id"), (None, "one two"), (None, None)]


@pytest.mark.parametrize("least,block,sample", [(80, 2048, 65536), (80, 7, 16), (60, 16, 64), (100, 2048, 65536)])
def test_against_all_pairs(spark, rows, monkeypatch, least, block, sample):
    monkeypatch.setattr(ngram_join, "SAMPLE", sample)
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, key int, n string").repartition(5)
    assert got(similar_texts(df, least, block=block)) == brute(rows, least)


def test_prefixes_of_any_order_meet():
    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(1, 120))
        x = np.unique(r.integers(0, 1 << 63, n, np.uint64))
        y = np.unique(np.r_[x[r.random(len(x)) > r.choice([0, 0.05, 0.2])], r.integers(0, 1 << 63, int(r.integers(0, 1 + n // 4)), np.uint64)])
        shared = len(np.intersect1d(x, y))
        assert shared <= most_shared(histogram(x), histogram(y), min(len(x), len(y)))
        similar = len(y) and 100 * shared >= 80 * (len(x) + len(y) - shared)
        assert bool(similar) == bool(len(y) and shared >= enough(len(x), len(y), 80))
        if similar:
            common = r.choice(x, len(x) // 3, replace=False)
            orders = Orders(np.sort(common), r.integers(4, 5000, len(common)))
            for k in range(4):
                p, q = (z[orders.prefix(z, orders.ranks(z), k, 80)] for z in (x, y))
                assert len(np.intersect1d(p, q))


def test_histograms_of_many_equal_low_bits():
    x = np.arange(400, dtype=np.uint64) << np.uint64(20)
    assert most_shared(histogram(x), histogram(x), 400) == 400
    assert len(shingles(b"a b c d e f g")) == 3


def test_large_group_makes_few_pairs(spark):
    """A text and thousands of copies with changes: pairs grow with the copies, not with their square."""
    r = random.Random(7)
    centre = [f"w{k}" for k in range(120)]
    n = 3000
    df = spark.createDataFrame([(0, " ".join(centre)), *((k, edited(r, centre, 2)) for k in range(1, n))], "doc_id long, text string").repartition(4)
    docs = df.select("doc_id", "text")
    orders = spark.sparkContext.broadcast(ngram_join.common_shingles(docs, 5))
    marks = ngram_join.marked(docs, orders, 80, 5)
    lists = ngram_join.prefix_lists(marks, 80)
    few = ngram_join.few_pairs(lists)
    assert few.count() <= 2 * n
    assert similar_texts(docs).filter(F.col("component_id") != 0).count() == 0


def test_empty(spark, empty):
    assert similar_texts(empty).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None), (3, " ")], "doc_id long, text string")
    assert got(similar_texts(blank)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
