"""Counts, ratios and scores of the toxicity model against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pairloom.llm import toxicity
from pairloom.llm.toxicity import BITS, ORDERS, Model, _count, fit_toxicity, score_toxicity


def plain_cells(text):
    """The cells of all n-grams of a text, by integer arithmetic."""
    codes, out = [ord(c) for c in f" {text.lower()} "], set()
    for n in ORDERS:
        for i in range(len(codes) - n + 1):
            h = codes[i]
            for c in codes[i + 1 : i + n]:
                h = (h * 0x01000193 + c) % 2**32
            out.add(((h ^ (h >> 15)) * 0x9E3779B1 % 2**32) >> (32 - BITS))
    return out


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdé XY.\n") for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_counts(spark):
    rows = [(t, k % 3 == 0) for k, t in enumerate(texts(60, 1))]
    seen, clean, toxic = _count(spark.createDataFrame([(t, int(b)) for t, b in rows], "text string, toxic int").repartition(3))
    want = [Counter(), Counter()]
    for t, b in rows:
        want[b].update(plain_cells(t))
    assert (clean, toxic) == (40, 20)
    for b in (0, 1):
        at = np.flatnonzero(seen[b])
        assert {int(c): int(seen[b, c]) for c in at} == dict(want[b])


def test_scores(spark):
    r = random.Random(2)
    docs = texts(40, 3)
    cells = sorted({c for t in docs[:20] for c in r.sample(sorted(plain_cells(t)), min(3, len(plain_cells(t))))})
    model = Model(np.array(cells), np.array([r.uniform(-3, 3) for _ in cells]), 0.25)
    weights = dict(zip(cells, model.weights, strict=True))
    for row in score_toxicity(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), model).collect():
        z = 0.25 + sum(weights.get(c, 0.0) for c in plain_cells(docs[row.doc_id]))
        assert row.score == pytest.approx(1 / (1 + math.exp(-z))) and row.predicted == (row.score >= 0.5)


def test_ratios_set_the_sign(spark):
    """Cells of toxic texts get weights that raise the score, the sign of their log-count ratio."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(("alpha", "beta", "gamma", "delta")) for _ in range(12)) + (" zzqqx" if i % 2 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit_toxicity(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    weights = dict(zip(model.cells.tolist(), model.weights.tolist(), strict=True))
    only = [weights[c] for c in plain_cells("zzqqx") if c in weights]
    assert only and min(only) > 0


def test_scoring_holds_little_beside_the_texts():
    """Many short texts and one long one: what scoring takes at its peak follows the piece, not the batch."""
    import tracemalloc

    rng = np.random.default_rng(3)
    known = np.sort(rng.choice(1 << toxicity.BITS, 1 << 20, replace=False))
    model = toxicity.Model(known, rng.normal(size=len(known)) / 100, 0.0)
    letters = np.frombuffer(b"abcdefgh ", np.uint8)
    short = [letters[rng.integers(0, len(letters), 1000)].tobytes().decode() for _ in range(6000)]
    whole = toxicity._scorer(model)
    assert np.allclose(whole(pa.RecordBatch.from_pydict({"text": short[:300]})), [whole(pa.RecordBatch.from_pydict({"text": [t]}))[0] for t in short[:300]])
    batch = pa.RecordBatch.from_pydict({"text": short})
    tracemalloc.start()
    whole(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    # a long text's pairs are brought together on the way; each cell stays once
    mask = np.zeros(1 << toxicity.BITS, bool)
    mask[known] = True
    owner, cells = toxicity._hits(["".join(short[:2000])], mask)
    codes = toxicity._codes(["".join(short[:2000])])[0]
    assert not owner.any() and cells.tolist() == sorted({c for _, g in toxicity._grams(codes) for c in g.tolist() if mask[c]})


def test_features_are_those_of_all_cells(spark):
    """What the ranges pick is what a table of all cells gives, ties at the limit included."""
    r = random.Random(6)
    rows = [(" ".join(r.choice(("alpha", "beta", "gamma", "delta")) for _ in range(r.randint(1, 9))) + (" zzqqx yyvv" if k % 3 == 0 and k % 5 else ""), int(k % 3 == 0)) for k in range(150)]
    df = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    seen, clean, toxic = _count(df)
    p, q = (seen[1] + 1.0) / (toxic + 2.0), (seen[0] + 1.0) / (clean + 2.0)
    ratio = np.log(p / q)
    z = ratio / np.sqrt((1 - p) / (toxic * p) + (1 - q) / (clean * q))
    strong = np.flatnonzero((np.abs(z) >= 1.0) & (seen.sum(0) >= 4))
    for most in (5, 17, 8192):
        want = np.sort(strong[np.argsort(-np.abs(z[strong]), kind="stable")[:most]])
        cells, ratios, *n = toxicity._features(df, most, 1.0, 1.0)
        assert cells.tolist() == want.tolist() and np.allclose(ratios, ratio[want], rtol=1e-12, atol=0) and n == [clean, toxic]


def test_learning_holds_no_table_of_cells_in_the_driver(spark):
    """tables of 2**22 numbers took about 200 MB of the driver's Python."""
    import tracemalloc

    rows = [(i, f"some words of text {i % 7} " + ("zzqqx" if i % 2 else "plain")) for i in range(120)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    tracemalloc.start()
    assert len(fit_toxicity(docs, labels).cells)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20, peak
