"""Operators over the whole corpus, each against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairloom.llm.common import Scratch
from pairloom.llm.elias_fano import EliasFano, Trie, restored
from pairloom.llm.language_model import GRID, score_texts
from pairloom.llm.mixing import mix_sources, take_copies
from pairloom.llm.neighbours import build_index, distances, nearest, query_points, valid_vectors, walk
from pairloom.llm.repeats import remove_repeats
from pairloom.llm.simhash import Tree, connect, fingerprint, keep_one, link_shard, near_duplicates

from .conftest import TEXTS


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


# --- SimHash --------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Union:
    def __init__(self):
        self.parent = {}

    def top(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.parent[max(a, b)] = min(a, b)


def test_tree_misses_no_link():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**64, 60, dtype=np.uint64)
    bit = lambda n: np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
    points = np.unique(np.concatenate([base[r.integers(0, 60, 900)] ^ bit(900) ^ bit(900), r.integers(0, 2**64, 600, dtype=np.uint64)]))
    want = Union()
    for p in points:
        for q in points[np.bitwise_count(points ^ p) <= 3]:
            want.join(int(p), int(q))
    for leaves in (1, 7, 16):
        shards, got = defaultdict(lambda: ([], [])), Union()
        for at, leaf, lives in Tree(points[::5], leaves).route(points, 3):
            shards[leaf][0].extend(points[at[lives]].tolist())
            shards[leaf][1].extend(points[at[~lives]].tolist())
        assert sum(len(a) for a, _ in shards.values()) == len(points)
        for a, b in shards.values():
            for u, v in zip(*(x.view(np.uint64).tolist() for x in link_shard(np.array(a, np.uint64), np.array(b, np.uint64), 3)), strict=True):
                got.join(u, v)
        assert all(got.top(int(p)) == want.top(int(p)) for p in points)


def near_texts(seed=3):
    r = random.Random(seed)
    out = []
    for _ in range(25):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(0, 200))]
        for _ in range(r.randint(1, 6)):
            own = list(base)
            for _ in range(r.randint(0, 2)):
                if own:
                    own[r.randrange(len(own))] = "changed"
            out.append(" ".join(own))
    return out


def test_near_duplicates(spark, docs, empty):
    rows = [*enumerate(near_texts(), 100), *TEXTS, (100, near_texts()[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fps = {t: brute_fingerprint(t) for _, t in rows}
    assert all(fingerprint((t or "").encode()) == f for t, f in fps.items())
    link = Union()
    for f in fps.values():
        for g in fps.values():
            if (f ^ g).bit_count() <= 3:
                link.join(f, g)
    least = {}
    for i, t in rows:
        if i is not None:
            k = link.top(fps[t])
            least[k] = min(i, least.get(k, i))
    got = near_duplicates(df).select("doc_id", F.hex("fp").alias("fp"), "component_id").collect()
    want = [(i, format(fps[t], "X"), least.get(link.top(fps[t]))) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert near_duplicates(empty).count() == 0
    kept = keep_one(df)
    assert kept.columns == df.columns and kept.count() == len({link.top(f) for f in fps.values()})
    assert keep_one(docs).columns == docs.columns


def test_connect(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + r.randint(0, 30), 100 + r.randint(0, 30)) for _ in range(25)] + [(200, 200 + k) for k in range(1, 60)]
    want = Union()
    for a, b in edges:
        want.join(a, b)
    got = {r.node: r.root for r in connect(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: want.top(x) for x in want.parent if want.top(x) != x}


def test_connect_raises_when_rounds_run_out(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError, match="still changed"):
        connect(path, Scratch(spark, "t"), most_rounds=2)
    assert connect(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), most_rounds=1).count() == 0


# --- repeats --------------------------------------------------------------------------------------------------------


def brute_repeats(rows):
    n = Counter()
    for _, t in rows:
        b = (t or "").encode()
        n.update(b[i : i + 200] for i in range(len(b) - 199))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if n[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((d, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [8192, 3])
def test_repeats(spark, empty, hot):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passages, rows = [text(80) for _ in range(6)], []
    for i in range(90):
        t = text(r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) - 1)
            t += p[a : a + r.randint(150, 600)] + text(r.randint(0, 50))
        rows.append((i, t))
    rows += [(200, "a" * 1000), (201, "ab" * 700), (202, None), (203, ""), (204, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (205, "x" * 199), (206, passages[0] * 2), (207, "y" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "at": F.lit("x"), "n": F.lit(2)}).repartition(4)
    got = remove_repeats(df, hot_blocks=hot, with_kept=True)
    assert sorted(str(tuple(x)[:5]) for x in got.collect()) == brute_repeats(rows)
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in got.collect())
    assert remove_repeats(empty).count() == 0


# --- mixing ---------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, left, full = {s: 1 + k % 3 for k, s in enumerate(names)}, float(sum(sizes.values())), {}
    while True:
        rest = [s for s in names if s not in full]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total >= 3 * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in rest}
        for s in over:
            full[s] = 3.0 * sizes[s]
        left = sum(sizes.values()) - sum(full.values())


def test_mixing(spark, docs, empty):
    r = random.Random(2)
    shares = {"a": 900, "b": 30, "ü": 60, "Z": 5, None: 200, "zz": 2}
    rows = [(k, " ".join("w" * r.randint(1, 400)), s) for s, n in shares.items() for k in range(n)]
    rows += [(1, None, "a"), (2, "", "empty"), (3, "x y", "b"), (3, "x y", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want, taken = brute_targets(dict(sizes)), Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source], abs=1e-6)
        assert x.taken == x.copies * x["size"] <= 3 * x["size"]
        taken[x.source] += x.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 210), (s, taken[s], t)
    again = mix_sources(df.repartition(5)).collect()
    key = lambda x: (str(x.doc_id), str(x.source), x["size"], x.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mix_sources(empty).count() == 0 and mix_sources(docs).count() == len(TEXTS)
    assert take_copies(df).count() == sum(x.copies for x in got) and take_copies(df).columns == df.columns



def tilted_rates(sizes, target, limit=3.0):
    """Plain bisection for min(limit, exp(lambda size)) whose words come to the target."""
    x = np.array([s for s in sizes if s], float)
    low, high = -60.0, math.log(limit)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (x * np.minimum(limit, np.exp(mid * x))).sum() < target else (low, mid)
    return lambda s: min(limit, math.exp(high * s)) if s else 0.0


def test_rates_tilt_documents(spark):
    r = random.Random(7)
    rows = [(k, " ".join("w" * r.choice((1, 3, 20, 200))), s) for s, n in (("a", 300), ("b", 25), ("c", 150), ("d", 40), (None, 60)) for k in range(n)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = defaultdict(list)
    for _, t, s in rows:
        sizes[s].append(len(words(t)))
    want = {s: tilted_rates(v, brute_targets({k: sum(z) for k, z in sizes.items()})[s]) for s, v in sizes.items()}
    assert len({round(x.rate, 6) for x in got if x.source == "a"}) > 3
    for x in got:
        assert x.rate == pytest.approx(want[x.source](x["size"]), rel=1e-5)
        assert math.floor(x.rate + 1e-9) <= x.copies <= math.ceil(x.rate - 1e-9) or x.copies == round(x.rate)


def test_mixing_raises_when_steps_run_out(spark):
    from pairloom.llm.mixing import balance, token_targets

    cells = spark.createDataFrame([("a", 5, 10), ("a", 900, 3), ("b", 7, 2)], "source string, size long, n long")
    targets = token_targets(cells.select("source", (F.col("size") * F.col("n")).alias("size")))
    with pytest.raises(RuntimeError, match="converged"):
        balance(cells, targets, Scratch(spark, "t"), most_steps=1)


def test_copies_with_clashing_names(spark, docs):
    names = ("copies", "__key", "__number", "__hash", "__id", "__source", "__copy", "size", "target", "row")
    df = docs.withColumns({c: F.lit(k) for k, c in enumerate(names)})
    got = take_copies(df)
    assert got.columns == df.columns and got.count() == mix_sources(docs).agg({"copies": "sum"}).first()[0]
    assert all([r[c] for c in names] == list(range(len(names))) for r in got.collect())


# --- language model -------------------------------------------------------------------------------------------------


def test_elias_fano_and_trie(tmp_path):
    r = np.random.default_rng(1)
    for universe in (1, 7, 1000, 10**9, 2**40, 2**64):
        for n in (0, 1, 500):
            x = np.sort(r.integers(0, universe - 1, n, np.uint64, endpoint=True))
            assert (EliasFano(**EliasFano.encode(x, universe))[np.arange(n)] == x).all()
    pairs = sorted({(int(a), int(b)) for a, b in r.integers(0, 50, (300, 2))})
    context, word = np.array(pairs, np.uint64).T * np.uint64(5_000_000_017)
    contexts, starts = np.unique(context, return_index=True)
    p, backoff = -r.random(len(pairs)) * 5, -r.random(len(contexts))
    buffer = Trie.build(contexts, np.append(starts, len(pairs)), word, p, backoff)
    (tmp_path / "trie").write_bytes(buffer)
    a, b = (z.ravel().astype(np.uint64) * np.uint64(5_000_000_017) for z in np.meshgrid(np.arange(60), np.arange(60)))
    want = dict(zip(zip(context.tolist(), word.tolist(), strict=True), p.tolist(), strict=True))
    for trie in (Trie(buffer), Trie(np.memmap(tmp_path / "trie", np.uint8, "r"))):
        rank = trie.context(a)
        assert ((rank >= 0) == np.isin(a, contexts)).all() and np.abs(restored(trie.backoff) - backoff).max() < 2e-4
        for i, j, q in zip(a.tolist(), b.tolist(), trie.find(rank, b).tolist(), strict=True):
            assert (q > 0) == ((i, j) in want) and (not q or abs(restored(q) - want[i, j]) < 2e-4)


def brute_scores(rows, discount=0.75):
    """By (id, text): log10 of the probability of each text under the interpolated bigram model of the training texts."""
    c, pairs = Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            w = [None, *words(t), None]
            c.update(w[1:])
            pairs.update(zip(w, w[1:], strict=False))
    n, v, types = sum(c.values()), len(c), Counter(a for a, _ in pairs)

    def score(g, i, t, left_out):
        w, s = [None, *words(t), None], 0.0
        for a, b in zip(w, w[1:], strict=False):
            u = (c[b] + 0.1) / (n + 0.1 * (v + 1))
            m, k, d = c[a] - left_out, pairs[a, b] - left_out, types[a] - (left_out and pairs[a, b] == 1)
            s += math.log10(g * (max(0.0, k - discount) / m + discount * d / m * u) + (1 - g) * u if m else u)
        return s

    train = [(i, t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    g = max(GRID, key=lambda g: sum(score(g, i, t, 1) for i, t in train))
    return {(i, t): score(g, i, t, 0) for i, t in rows}


def test_scores(spark, empty, tmp_path):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["The", "the", "of", "é", "ZZ", f"rare{r.randint(0, 99)}"]) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(k + 1000, rows[k][1]) for k in range(40)] + [t for t in TEXTS if t[0] != 7] + [(5, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = score_texts(df, block_bytes=4000, shard_tokens=400, model_path=str(tmp_path / "model")).collect()
    assert len(got) == len(rows)
    tries = spark.read.parquet(str(tmp_path / "model")).collect()
    assert sum(Trie(x.trie).successors.n for x in tries) == sum(x.pairs for x in tries) > 0 and len(tries) > 5
    want = sorted((str(i), len(words(t)) + 1, s) for (i, t), s in brute_scores(rows).items() for _ in range(rows.count((i, t))))
    for x, (i, n, s) in zip(sorted(got, key=lambda x: (str(x.doc_id), x.n_tokens, x.score)), want, strict=True):
        assert (str(x.doc_id), x.n_tokens) == (i, n) and abs(x.score - s) < 4e-4 * n
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]), 6)) for i, t in rows)
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    out = [x for x in got if x.held_out]
    assert sum(x.score for x in out) > sum(x.base_score for x in out)
    one = {(x.doc_id, x.n_tokens): x.score for x in score_texts(df).collect()}
    assert all(abs(one[x.doc_id, x.n_tokens] - x.score) < 4e-4 * x.n_tokens for x in got)  # blocks and shards don't change scores
    assert score_texts(empty).count() == 0


# --- nearest --------------------------------------------------------------------------------------------------------


def test_nearest(spark):
    r = np.random.default_rng(3)
    centers = r.normal(size=(12, 16))
    x = centers[r.integers(0, 12, 3000)] + 0.4 * r.normal(size=(3000, 16))
    x[500:900] = x[500]  # one common vector
    rows = [(i, [float(v) for v in np.float32(e)]) for i, e in enumerate(x)]
    rows += [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None] * 16), (9080, [1.0] * 3), (None, [1.0] * 16), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("x"))
    v = valid_vectors(df, "vec_id", "embedding")
    got = nearest(v, v.filter("vec_id % 20 = 0").dropDuplicates(["vec_id"]), Scratch(spark, "t"), list_rows=100, shard_rows=150).collect()
    x = np.float32(x).astype(float)
    by = defaultdict(list)
    for row in got:
        by[row.query_id].append(row)
        assert row.score == pytest.approx(float(x[row.query_id] @ x[row.vec_id]), abs=1e-9) and row.vec_id != row.query_id
    assert set(by) == set(range(0, 3000, 20))
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({r.vec_id for r in found} & set(np.lexsort((np.arange(3000), -np.round(s, 9)))[:20].tolist()))
    assert hits / (20 * len(by)) > 0.9
    none = v.filter("false")
    assert nearest(none, none, Scratch(spark, "t")).count() == 0
    few = v.filter("vec_id < 5 or vec_id = 20")
    assert nearest(few, few.filter("vec_id % 20 = 0").dropDuplicates(["vec_id"]), Scratch(spark, "t")).count() == 10


def check_nearest(spark, x, rows, least, **given):
    """nearest over rows of ids into x, against brute force for every 20th id."""
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in rows], "vec_id long, embedding array<double>").repartition(4)
    v = valid_vectors(df, "vec_id", "embedding")
    by = defaultdict(dict)
    for row in nearest(v, v.filter("vec_id % 20 = 0"), Scratch(spark, "t"), **given).collect():
        by[row.query_id][row["rank"]] = row.vec_id
    hits = 0
    for q in range(0, len(x), 20):
        assert sorted(by[q]) == list(range(1, 21)) and len(set(by[q].values())) == 20
        s = np.round(x @ x[q], 9)
        s[q] = -np.inf
        # what scores as much as the 20th counts, whatever its id
        hits += sum(s[i] >= np.sort(s)[-20] for i in by[q].values())
    assert hits / (20 * len(by)) >= least


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_nearest_repeated_rows(spark):
    r = np.random.default_rng(4)
    x = unit(r.normal(size=(12, 16))[r.integers(0, 12, 1500)] + 0.4 * r.normal(size=(1500, 16)))
    check_nearest(spark, x, [*range(1500), *range(1500), *[41] * 400], 0.9, list_rows=100, shard_rows=150)


@pytest.mark.parametrize("n, hot, groups", [(2000, 0, 0), (12000, 0, 0), (12000, 4000, 0), (6000, 2000, 300)])
def test_nearest_recall_by_size_and_hot_vector(spark, n, hot, groups):
    r = np.random.default_rng(n + hot)
    x = unit(r.normal(size=(groups, 32))[r.integers(0, groups, n)] + 0.3 * r.normal(size=(n, 32)) if groups else r.normal(size=(n, 32)))
    x[r.permutation(n)[:hot]] = x[0]
    check_nearest(spark, x, range(n), 0.93, list_rows=32, sample_rows=4096)


@pytest.mark.parametrize("kind, most", [("norms", 0.25), ("groups", 0.1), ("even", 0.9)])
def test_nearest_scans_part_of_the_table(spark, kind, most):
    """Recall against brute force and the share of the table that a query is compared with, by the shape of the vectors."""
    r = np.random.default_rng(11)
    x = r.normal(size=(8000, 48))
    if kind == "norms":
        x *= np.exp(r.normal(size=(8000, 1)))
    if kind == "groups":
        x = r.normal(size=(200, 48))[r.integers(0, 200, 8000)] + 0.4 * r.normal(size=(8000, 48))
    check_nearest(spark, x, range(8000), 0.9)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(8000)], "vec_id long, embedding array<double>")
    v = valid_vectors(df, "vec_id", "embedding")
    scanned = nearest(v, v.filter("vec_id % 20 = 0"), Scratch(spark, "t")).groupBy("query_id").agg(F.max("scanned").alias("n")).agg(F.avg("n"), F.count("*")).first()
    assert scanned[1] == 400 and scanned[0] < most * 8000


def test_walk_finds_what_all_distances_find():
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 16))
    band = build_index(x, float(np.linalg.norm(x, axis=1).max()), 300).bands[0]
    points = query_points(x[:200], band)
    want, got = distances(points, band.centroids), np.full((200, len(band.centroids)), np.inf)
    row, to, d = walk(points, band, 1.2, 0.0)
    got[row, to] = d
    assert len(np.unique(row * len(band.centroids) + to)) == len(row)
    near = want <= want.min(1)[:, None] * 1.2
    assert np.isfinite(got[near]).mean() > 0.99 and np.allclose(got[np.isfinite(got)], want[np.isfinite(got)], atol=1e-6)


def test_walk_meets_part_of_the_graph():
    """Among groups most centroids are not met, and the closest one is found for nearly all queries."""
    r = np.random.default_rng(8)
    x = r.normal(size=(200, 48))[r.integers(0, 200, 30000)] + 0.1 * r.normal(size=(30000, 48))
    band = build_index(x, float(np.linalg.norm(x, axis=1).max()), 2000).bands[0]
    points = query_points(x[:300], band)
    every = distances(points, band.centroids)
    row, _, d = walk(points, band, 1.05, float(np.median(every.min(1))))
    near = np.full(300, np.inf)
    np.minimum.at(near, row, d)
    assert len(row) < 0.5 * every.size and (near <= every.min(1) + 1e-6).mean() > 0.9
    assert len(walk(points[:0], band, 1.1, 0.0)[0]) == 0
