"""The semi-Markov field: sums and best paths against enumeration, held-out precision and recall, hard cases."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm.personal import find_personal, mask_personal, personal_spans, trained
from pairloom.llm.personal_model import EMAIL, CARD, KINDS, PHONE, best_segments, marginals, sentences


def segmentations(n, segments):
    """All sets of segments that don't overlap."""
    for k in range(len(segments) + 1):
        for some in itertools.combinations(range(len(segments)), k):
            spans = sorted(segments[e][:2] for e in some)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)):
                yield some


def random_problem(r):
    n = r.randint(1, 5)
    spans = [(i, j) for i in range(n) for j in range(i + 1, n + 1)]
    return n, [(*r.choice(spans), r.randrange(2), r.uniform(-2, 2)) for _ in range(r.randint(0, 7))]


def test_sums_over_all_segmentations():
    r = random.Random(1)
    many = [random_problem(r) for _ in range(40)]
    owner = np.array([k for k, (_, s) in enumerate(many) for _ in s])
    i, j, score = (np.array([x[c] for _, s in many for x in s]) for c in (0, 1, 3))
    p, total = marginals(np.array([n for n, _ in many]), owner, i, j, score)
    at = 0
    for k, (n, segments) in enumerate(many):
        weights = {some: math.exp(sum(segments[e][3] for e in some)) for some in segmentations(n, segments)}
        z = sum(weights.values())
        assert total[k] == pytest.approx(math.log(z))
        for e in range(len(segments)):
            assert p[at + e] == pytest.approx(sum(w for some, w in weights.items() if e in some) / z)
        at += len(segments)


def test_best_segmentation():
    r = random.Random(2)
    for _ in range(200):
        n, segments = random_problem(r)
        want = max(sum(segments[e][3] for e in some) for some in segmentations(n, segments))
        found = best_segments(n, segments)
        value = sum(max(s for a, b, k, s in segments if (a, b, k) == x) for x in found)
        assert value == pytest.approx(want) and all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_held_out_sentences():
    """Sentences drawn with another seed: precision and recall of the added spans, by kind."""
    w, hit, said, true = trained(), Counter(), Counter(), Counter()
    for text, spans in sentences(3000, 77):
        base, added = personal_spans(text, w)
        want = {x for x in spans if not any(s < x[2] and x[1] < e for _, s, e in base)}
        hit.update(x[0] for x in want & set(added))
        said.update(x[0] for x in added)
        true.update(x[0] for x in want)
    for kind, precision, recall in ((EMAIL, 0.93, 0.88), (CARD, 0.95, 0.95), (PHONE, 0.85, 0.8)):
        assert hit[kind] / said[kind] > precision and hit[kind] / true[kind] > recall, KINDS[kind]


def test_written_forms():
    w = trained()
    cases = {
        "call 415 555 1234 please": "415 555 1234",
        "phone: 415.555.1234": "415.555.1234",
        "tel 020 7946 0958": "020 7946 0958",
        "call (030) 123456": "(030) 123456",
        "phone 06 12 34 56 78": "06 12 34 56 78",
        "joe at example dot com": "joe at example dot com",
        "email is joe @ example.com": "joe @ example.com",
        "write firstname.middlename.lastname (at) mail.department.university.edu": "firstname.middlename.lastname (at) mail.department.university.edu",
        "amex 3782 822463 10005": "3782 822463 10005",
    }
    for text, want in cases.items():
        assert [text[a:b] for _, a, b in personal_spans(text, w)[1]] == [want], text
    for text in ("ISBN 415-555-1234", "order 415-555-1234", "we met at the polka dot house", "0cab398dc11d1a2a11dc6572c8df8bd228c864f3", "on 12/05/2024 at noon"):
        assert personal_spans(text, w)[1] == [], text


def test_spans_do_not_overlap():
    w, r = trained(), random.Random(4)
    for _ in range(1500):
        text = "".join(r.choice(["a", "b ", "@", " at ", " dot ", "(at)", ".com", "+", "-", " ", "415", "55", "1234", ".", "4111", "/", "\n", "é"]) for _ in range(r.randint(0, 25)))
        base, added = personal_spans(text, w)
        every = sorted((a, b) for _, a, b in added)
        assert all(x[1] <= y[0] for x, y in zip(every, every[1:], strict=False))
        assert not any(s < b and a < e for a, b in every for _, s, e in base)


def test_long_texts_and_clashing_names(spark, docs):
    long = "x" * 200_000 + " joe at example dot com " + "7" * 50_000 + " " + "a at b dot " * 2000
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert "email" in find_personal(df).first().spans and "[email]" in mask_personal(df).first().text
    other = docs.withColumns({"n_email": F.lit(1), "spans": F.lit(2), "base_sha256": F.lit("x")})
    assert find_personal(other).count() == docs.count() and mask_personal(other).columns == other.columns
