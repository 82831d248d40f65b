"""Rows that repeat an id and a text: covered as a whole, in a time that grows with them."""

import random
import time

from pairloom.llm.repeats import WIDTH, remove_repeats


def kept(texts):
    """The bytes left of each text by the rule itself."""
    starts = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - WIDTH + 1):
            starts.setdefault(t[i : i + WIDTH], []).append((k, i))
    gone = [bytearray(len(t)) for t in texts]
    for where in starts.values():
        if len(where) > 1:
            for k, i in where:
                gone[k][i : i + WIDTH] = b"\x01" * WIDTH
    return [bytes(c for c, g in zip(t, g, strict=True) if not g) for t, g in zip(texts, gone, strict=True)]


def rows(copies, r):
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    base, part = word(3000), word(300)
    return [(1, base)] * copies + [(2, word(100) + part), (3, part + word(500)), (2, word(100) + base[700:1200]), (4, "short"), (4, "short"), (None, word(250)), (5, word(199)), (5, ""), (5, None)]


def test_against_plain(spark):
    for hot in (8192, 0):
        r = random.Random(hot)
        data = [*rows(3, r), (None, "x" * 250), (None, "x" * 250), (6, "y" * 500)]
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
        got = remove_repeats(df, hot_blocks=hot, with_kept=True).collect()
        want = [(i, k) for (i, _), k in zip(data, kept([(t or "").encode() for _, t in data]), strict=True)]
        key = lambda x: (str(x[0]), x[1])
        assert sorted(((x.doc_id, bytes(x.kept)) for x in got), key=key) == sorted(want, key=key)


def test_many_copies_of_one_row(spark):
    took = {}
    for n in (200, 5000):
        df = spark.createDataFrame(rows(n, random.Random(1)), "doc_id long, text string").repartition(4)
        start = time.perf_counter()
        got = remove_repeats(df).collect()
        took[n] = time.perf_counter() - start
        assert len(got) == n + 9 and sum(x.n_removed for x in got if x.doc_id == 1) == 3000 * n
    assert took[5000] < 60
