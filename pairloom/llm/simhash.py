"""Near duplicates by SimHash, linked exactly with vantage-point trees.

A fingerprint has a bit where more than half of the XXH64 values of a text's word shingles have it. Equal fingerprints
are one node. A tree of vantage points, built from a bounded sample of fingerprints, splits the Hamming space into
shards: inside or outside the median distance of a vantage point. A fingerprint lives in one shard; its ball of
radius `most_bits` is followed through the tree, and by the triangle inequality

    d(q, v) - radius <= split   may have links inside,     d(q, v) + radius > split   outside,

so it is also sent as a query to every later shard that its ball touches. In a shard a local tree prunes branches by
the same bounds and compares what is left exactly. No pair within the radius is missed: its earlier member visits the
shard of the other one. A shard returns a spanning star of each of its components instead of all pairs, and stars are
joined by alternating large-star and small-star rounds until nothing changes.

The sample (`sample_rows` fingerprints) only shapes the tree; results don't depend on it. The number of shards follows
the number of distinct fingerprints. Nulls: a null text counts as empty, with fingerprint zero, linked like any other;
a row without an id gets the component of its fingerprint, which is null if no member has an id. Repeated rows stay
repeated. The shingles of a very long text are hashed whole, their bits counted in stretches. An empty table gives an
empty result. Columns beside id and text are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, fresh, map_arrow, text_of

SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 17
#: Points that a leaf of a local tree compares one by one.
LEAF = 96


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The XXH64 values of a text's word shingles, repeats included; a text with fewer words is one, without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = words if width == 1 else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(words) - width + 1))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    """The fingerprint of a text, by the bits of its shingles' hashes."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) of every document."""
    out = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t, width) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))], schema=out)

        return step

    whole = text_of(text)
    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_hash"), whole.alias("text")), start, "doc_id long, text_hash long, fp long")


# --- vantage-point trees --------------------------------------------------------------------------------------------


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _split(points: np.ndarray, tries: int = 12) -> tuple[np.uint64, int] | None:
    """A vantage point and the distance that halves the points best; None if no point tells them apart."""
    best = None
    for v in points[:: max(1, len(points) // tries)][:tries]:
        d = np.sort(distance(points, v))
        for cut in {int(d[len(d) // 2]), int(d[len(d) // 2]) - 1}:
            inside = int(np.searchsorted(d, cut, "right"))
            near = int(np.searchsorted(d, cut + 3, "right") - np.searchsorted(d, cut - 3, "left"))
            if 0 < inside < len(d) and (best is None or (abs(2 * inside - len(d)) + near, int(v)) < best[0]):
                best = ((abs(2 * inside - len(d)) + near, int(v)), v, cut)
    return best and (best[1], best[2])


class Tree:
    """Nodes are (vantage point, distance, inside, outside); a leaf is its number."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.n = 0
        self.root = self._build(points, leaves)

    def _build(self, points: np.ndarray, leaves: int):
        found = _split(points) if leaves > 1 and len(points) > 1 else None
        if found is None:
            self.n += 1
            return self.n - 1
        v, cut = found
        inside = distance(points, v) <= cut
        left = self._build(points[inside], leaves // 2)
        return (v, cut, left, self._build(points[~inside], leaves - leaves // 2))

    def route(self, points: np.ndarray, radius: int):
        """(index of point, leaf, whether it lives there) for its own leaf and all later ones that its ball touches."""
        home = np.zeros(len(points), np.int32)
        found = []

        def walk(node, at: np.ndarray, lives: np.ndarray) -> None:
            if isinstance(node, int):
                home[at[lives]] = node
                found.append((at, node, lives))
            elif len(at):
                v, cut, left, right = node
                d = distance(points[at], v)
                near, far = d - radius <= cut, d + radius > cut
                walk(left, at[near], lives[near] & (d[near] <= cut))
                walk(right, at[far], lives[far] & (d[far] > cut))

        walk(self.root, np.arange(len(points)), np.ones(len(points), bool))
        for at, leaf, lives in found:
            keep = lives | (home[at] < leaf)
            yield at[keep], leaf, lives[keep]


def link_shard(points: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of the components that points and queries form by links of points with either; roots left out."""
    both = np.concatenate([points, queries])
    label = np.arange(len(both))

    def join(a: np.ndarray, b: np.ndarray) -> None:
        """Merges the labels of a with those of b, pair by pair."""
        nonlocal label
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        pairs = np.unique(np.stack([np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])]), axis=1)
        parent = {int(v): int(v) for v in np.unique(pairs)}

        def top(v: int) -> int:
            while parent[v] != v:
                parent[v] = v = parent[parent[v]]
            return v

        for v, w in pairs.T.tolist():
            v, w = top(v), top(w)
            parent[max(v, w)] = min(v, w)
        to = np.arange(len(label))
        for v in parent:
            to[v] = top(v)
        label = to[label]

    def walk(own: np.ndarray, asked: np.ndarray) -> None:
        if not len(own) or not len(asked):
            return
        found = _split(both[own]) if len(own) > LEAF else None
        if found is None:
            for i in range(0, len(own), LEAF):
                block = own[i : i + LEAF]
                for j in range(0, len(asked), 1 << 14):
                    some = asked[j : j + (1 << 14)]
                    q, p = np.nonzero(np.bitwise_count(both[some][:, None] ^ both[block][None, :]) <= radius)
                    join(some[q], block[p])
            return
        v, cut = found
        d, e = distance(both[own], v), distance(both[asked], v)
        walk(own[d <= cut], asked[e - radius <= cut])
        walk(own[d > cut], asked[e + radius > cut])

    walk(np.arange(len(points)), np.arange(len(both)))
    order = np.lexsort((both.view(np.int64), label))
    first = np.ones(len(order), bool)
    first[1:] = label[order][1:] != label[order][:-1]
    root = both[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else both
    return both[order][~first].view(np.int64), root[~first].view(np.int64)


def link_fingerprints(nodes: DataFrame, scratch: Scratch, most_bits: int = 3, shard_rows: int = 16384, sample_rows: int = 8192) -> DataFrame:
    """(a, b): spanning stars of the links between the distinct fingerprints nodes(fp)."""
    n = nodes.count()
    leaves = max(1, -(-n // shard_rows))
    # each leaf is shaped by a bounded number of sample points
    take = max(sample_rows, 64 * leaves)
    sample = [r.fp for r in nodes.orderBy(F.xxhash64(F.lit("vantage"), "fp"), "fp").limit(min(take, 1 << 17)).collect()]
    tree = Tree(np.array(sample, np.int64).view(np.uint64), leaves)
    routed = pa.schema([("shard", pa.int32()), ("fp", pa.int64()), ("lives", pa.bool_())])

    def route(batches):
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            for at, leaf, lives in tree.route(points, most_bits):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf, np.int32)), pa.array(points[at].view(np.int64)), pa.array(lives)], schema=routed)

    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(table: pa.Table) -> pa.Table:
        fp, lives = table.column("fp").to_numpy().view(np.uint64), table.column("lives").to_numpy()
        a, b = link_shard(np.sort(fp[lives]), np.sort(fp[~lives]), most_bits)
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], schema=out)

    return scratch.save(nodes.select("fp").mapInArrow(route, "shard int, fp long, lives boolean").groupBy("shard").applyInArrow(link, "a long, b long"), "links")


def connect(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, for every node that is not it. Edges are (a, b).

    Large-star and small-star rounds; hot nodes meet only sums (map-side combined) and skew-split joins. Raises if
    `most_rounds` rounds don't settle the components, which would be split silently otherwise.
    """
    rows = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "round0")
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(rows)
    for k in range(1, most_rounds):
        if not before[0]:
            break
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        rows = scratch.save(small, f"round{k}")
        after = sign(rows)
        if k > 1:
            scratch.drop(f"round{k - 2}")
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components still changed after {most_rounds} rounds")
    return rows.select(F.col("u").alias("node"), F.col("v").alias("root"))


def roots_of(nodes: DataFrame, scratch: Scratch, most_bits: int = 3) -> DataFrame:
    """fp and root, the smallest fingerprint linked with it, of the distinct fingerprints nodes(fp)."""
    roots = connect(link_fingerprints(nodes, scratch, most_bits), scratch)
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, most_bits: int = 3) -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint for each component) and component_id of every document."""
    scratch = Scratch(docs.sparkSession, "simhash")
    found = scratch.save(fingerprints(docs, doc_id, text, width), "fingerprints")
    nodes = scratch.save(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    named = roots_of(nodes, scratch, most_bits)
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = scratch.save(named.join(groups, "root").select("fp", "root", "component_id"), "classes")
    return found.join(classes, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = near_duplicates(documents(spark, sf_dir))
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id, with all its columns."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    own, id_, hash_ = fresh(docs, "own", "id", "hash")
    found = near_duplicates(docs.select("doc_id", "text"))
    groups = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x"))
    keep = scratch.save(groups.select(F.col("x.doc_id").alias(id_), F.col("x.text_hash").alias(hash_)), "keep")
    kept = docs.withColumn(own, F.xxhash64(text_of())).join(keep, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_)), "left_semi")
    # repeated rows have the same id and text; one of each stays
    return kept.dropDuplicates(["doc_id", own]).drop(own)
