"""Approximate nearest neighbours by largest inner product: balanced posting lists under an in-memory centroid graph.

Vectors are dealt to bands by norm, each half as long as the one before. In a band one more component,
sqrt(longest^2 - |x|^2), makes the largest inner product the smallest distance. Centroids come from the distinct vectors
of a bounded sample, halved again and again at the median between two means, so lists are balanced; equal centroids are
one. There are as many as the table has rows for, `list_rows` each. Every vector is indexed: in the list of its closest
centroid and, near a boundary, in others whose distance is at most `replicate` times as large, unless a centroid
already chosen is much closer to that centroid than the vector is.

A query walks a band's graph of centroids (each linked both ways with its nearest ones and with its neighbours in the
tree, so all are connected) from spread entries, and goes on as long as it finds centroids within the pruning limit or
among its closest. Lists whose distance is at most a ratio times the smallest one are searched (distance-ratio
pruning), and more while these are home to fewer than `top` other vectors. The ratios are measured on the table itself:
`probe` queries are answered exactly over all vectors, and a band's ratio is the smallest one whose lists, as the walk
finds them, hold `recall` of those answers. A smallest distance below the median one counts as the median one there, or
a query on a centroid would have no list beside its own. Lists whose longest vector can't reach what `top` of the
`anchors` longest vectors of the table reach are left out, which loses nothing.

Lists that are neighbours in the tree share a shard of about `shard_rows` postings; a longer list is cut by a hash of
the id into shards of its own, and a query goes to all of them, so no task holds an unbounded list, whatever share of
the rows one vector has. A query is sent once to a shard, with the numbers of its lists there, and compared with those
lists only. Scores are exact double inner products of the original vectors; `scanned` is how many postings a query was
compared with.

Bounds (parameters): at most `most_lists` centroids with their graph are broadcast, fitted on `fit_rows` vectors a list
(`sample_rows` at most); beyond, lists grow longer and are cut. Vectors that are null, zero or hold null or non-finite
components take no part, nor do vectors without an id or of another length than most have. Rows that repeat an id
count once. Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Scratch

EXTRA = 1e-9
#: Numbers held at once in tables of distances.
CELLS = 1 << 22


@dataclass(frozen=True)
class Band:
    """The lists of vectors whose norms are alike."""

    #: No vector of the band is longer.
    longest: float
    #: The number of its first list.
    first: int
    #: In the order of the tree's leaves.
    centroids: np.ndarray
    #: The graph: the neighbours of centroid i are links[starts[i] : starts[i + 1]].
    starts: np.ndarray
    links: np.ndarray


@dataclass(frozen=True)
class Index:
    """Bands, the longest vectors first; each halves the norm of the one before."""

    bands: tuple[Band, ...]

    @property
    def lists(self) -> int:
        return self.bands[-1].first + len(self.bands[-1].centroids)

    def band_of(self, norm: np.ndarray) -> np.ndarray:
        low = np.array([b.longest for b in self.bands[1:]])
        return (norm[:, None] <= low[None, :] * (1 + 1e-12)).sum(1)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, longest**2 - (x * x).sum(1)))])


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Means of balanced cells: each cell is halved at the median of the difference of its distances to two means."""
    if lists <= 1 or len(x) <= 1:
        return x.mean(0, keepdims=True)
    a = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    b = x[((x - a) ** 2).sum(1).argmax()]
    share = (lists // 2) / lists
    for _ in range(rounds):
        side = x @ (b - a)
        order = np.argsort(side, kind="stable")
        cut = min(len(x) - 1, max(1, round(len(x) * share)))
        a, b = x[order[:cut]].mean(0), x[order[cut:]].mean(0)
    return np.concatenate([balanced_centroids(x[order[:cut]], lists // 2), balanced_centroids(x[order[cut:]], lists - lists // 2)])


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T))


def pieces_of(n: int, width: int):
    """Slices of n rows such that a table of `width` numbers a row stays within CELLS."""
    step = max(1, CELLS // max(1, width))
    return (slice(i, i + step) for i in range(0, n, step))


def linked(c: np.ndarray, near: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The graph over centroids: links both ways to the nearest ones, and to the next one in the tree."""
    n = len(c)
    k = min(near + 1, n)
    a, b = [np.arange(n - 1)], [np.arange(1, n)]
    for s in pieces_of(n, n):
        d = distances(c[s], c)
        found = np.argpartition(d, k - 1, axis=1)[:, :k]
        a.append(np.repeat(np.arange(n)[s], k))
        b.append(found.ravel())
    a, b = np.concatenate(a), np.concatenate(b)
    key = np.unique(np.concatenate([a * n + b, b * n + a])[np.concatenate([a != b, a != b])])
    return np.searchsorted(key, np.arange(n + 1) * n), key % n


def build_index(sample: np.ndarray, longest: float, lists: int, bands: int = 8) -> Index:
    """Lists are dealt to the bands by their vectors in the sample."""
    sample = np.unique(sample, axis=0)
    norm = np.sqrt((sample * sample).sum(1))
    level = np.clip(np.ceil(np.log2(longest / norm) - 1e-9).astype(int) - 1, 0, bands - 1)
    found, first = [], 0
    for k in np.unique(level):
        own = sample[level == k]
        top = longest / 2**k
        c = balanced_centroids(lifted(own, top), max(1, round(lists * len(own) / len(sample))))
        c = c[np.sort(np.unique(c, axis=0, return_index=True)[1])]
        found.append(Band(top, first, c, *linked(c)))
        first += len(c)
    return Index(tuple(found))


def assign(x: np.ndarray, index: Index, replicate: float, most: int, spread: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, whether it is the closest one) of the lists that hold each vector."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    level = index.band_of(np.sqrt((x * x).sum(1)))
    for number, band in enumerate(index.bands):
        c, rows = band.centroids, np.flatnonzero(level == number)
        k = min(most, len(c))
        for s in pieces_of(len(rows), len(c)):
            d = distances(lifted(x[rows[s]], band.longest), c)
            near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(k), (len(d), 1))
            dn = np.take_along_axis(d, near, 1)
            order = np.lexsort((near, dn), axis=1)
            near, dn = np.take_along_axis(near, order, 1), np.take_along_axis(dn, order, 1)
            keep = dn <= dn[:, :1] * replicate + 1e-12
            keep[:, 0] = True
            for j in range(1, k):
                for i in range(j):
                    apart = np.sqrt(((c[near[:, i]] - c[near[:, j]]) ** 2).sum(1))
                    keep[:, j] &= ~(keep[:, i] & (apart < dn[:, j] * spread))
            row, col = np.nonzero(keep)
            out.append((rows[s][row], near[row, col] + band.first, col == 0))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def query_points(q: np.ndarray, band: Band) -> np.ndarray:
    """Queries as points among the lifted vectors of a band."""
    at = q * (band.longest / np.sqrt((q * q).sum(1)))[:, None]
    return np.column_stack([at, np.zeros(len(q))])


def _nearest_few(row: np.ndarray, to: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (row, to, d) the k closest of each row, and their place among them."""
    order = np.lexsort((to, d, row))
    row, to, d = row[order], to[order], d[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], to[keep], d[keep], place[keep]


def walk(points: np.ndarray, band: Band, ratio: float, typical: float, beam: int = 8, entries: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query point, centroid, distance) of the centroids that a best-first walk over the graph meets, by query point.

    A walk starts from spread entries and goes on from every centroid within the pruning limit of the closest one so
    far, or among its `beam` closest. The limit only falls, so a centroid is judged when it is met and never again: a
    step costs what it meets, not what the graph holds. Where a step meets a large part of the graph, as the limit asks
    for among even vectors, the distances of all come from one product.
    """
    c, n, m = band.centroids, len(band.centroids), len(points)
    degree, seen = np.diff(band.starts), np.zeros(m * n, bool)
    first = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(np.int64))
    row, to = np.repeat(np.arange(m), len(first)), np.tile(first, m)
    best, every, met = np.full(m, np.inf), None, []
    pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    while len(row):
        seen[row * n + to] = True
        if every is None and 8 * len(row) > m * n:
            every = distances(points, c)
        if every is not None:
            d = every[row, to]
        else:
            d = np.concatenate([np.sqrt(((points[row[s]] - c[to[s]]) ** 2).sum(1)) for s in pieces_of(len(row), c.shape[1])])
        met.append((row, to, d))
        np.minimum.at(best, row, d)
        *pool, place = _nearest_few(*(np.concatenate(x) for x in zip(pool, (row, to, d), strict=True)), beam)
        last = np.full(m, -np.inf)
        full = place == beam - 1
        last[pool[0][full]] = pool[2][full]
        short = np.ones(m, bool)
        short[pool[0][full]] = False
        go = (d <= np.maximum(np.maximum(best, typical) * ratio, last)[row]) | short[row]
        a, b = row[go], to[go]
        each = degree[b]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(band.starts[b], each)
        key = np.repeat(a, each) * n + band.links[at]
        key = np.unique(key[~seen[key]])
        row, to = key // n, key % n
    row, to, d = (np.concatenate(x) for x in zip(*met, strict=True)) if met else pool
    order = np.argsort(row, kind="stable")
    return row[order], to[order], d[order]


@dataclass(frozen=True)
class Lists:
    """What is known of the posting lists of a table, by list; and of its bands, by band."""

    counts: np.ndarray
    #: Vectors whose closest list it is.
    homes: np.ndarray
    #: The norm of the longest vector.
    norms: np.ndarray
    #: Distance ratio and median distance to the closest list, for each band.
    ratio: np.ndarray
    typical: np.ndarray


def chosen(q: np.ndarray, floor: np.ndarray, index: Index, lists: Lists, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): the lists to search. No vector of a list whose norms are below floor / |q| can be an answer."""
    alive, norm = lists.counts > 0, np.sqrt((q * q).sum(1))
    out = []
    for s in pieces_of(len(q), 2 * index.lists):
        reach = alive & (norm[s, None] * lists.norms[None, :] * (1 + 1e-9) >= floor[s, None])
        keep = np.zeros(reach.shape, bool)
        for k, band in enumerate(index.bands):
            at = slice(band.first, band.first + len(band.centroids))
            some = np.flatnonzero(reach[:, at].any(1))
            if len(some):
                met, to, d = walk(query_points(q[s][some], band), band, lists.ratio[k], lists.typical[k])
                there = alive[band.first + to]
                near = np.full(len(some), np.inf)
                np.minimum.at(near, met[there], d[there])
                hit = there & (d <= np.maximum(near, lists.typical[k])[met] * lists.ratio[k])
                keep[some[met[hit]], band.first + to[hit]] = reach[some[met[hit]], band.first + to[hit]]
        for i in np.flatnonzero(keep @ lists.homes < least):
            # too few vectors: the closest lists, band by band, until there are enough
            for band in index.bands:
                at = np.arange(band.first, band.first + len(band.centroids))
                at = at[alive[at] & ~keep[i, at]]
                near = at[np.argsort(distances(query_points(q[s][i : i + 1], band), band.centroids[at - band.first])[0], kind="stable")]
                have = int(lists.homes[keep[i]].sum())
                keep[i, near[: int(np.searchsorted(np.cumsum(lists.homes[near]), least - have)) + 1]] = True
                if lists.homes[keep[i]].sum() >= least:
                    break
        row, own = np.nonzero(keep)
        out.append((row + s.start, own))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def floors(q: np.ndarray, ids: np.ndarray, anchors: np.ndarray, anchor_ids: np.ndarray, top: int) -> np.ndarray:
    """A score that `top` vectors beside the query's own reach for certain: the top-th best of the anchors'."""
    if len(anchors) <= top:
        return np.full(len(q), -np.inf)
    scores = np.where(ids[:, None] == anchor_ids[None, :], -np.inf, q @ anchors.T)
    found = np.partition(scores, len(anchors) - top, axis=1)[:, len(anchors) - top]
    return found - EXTRA * np.maximum(1.0, np.abs(found))


def true_nearest(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, top: int) -> pa.Table:
    """(probe, v): the vectors that an exact search of the whole table finds for each of a bounded number of queries."""

    def run(batches):
        held_ids, held = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for batch in batches:
            own = batch.column("vec_id").to_numpy()
            scores = q @ _matrix(batch.column("v")).T
            scores[ids[:, None] == own[None, :]] = -np.inf
            held_ids, held = np.concatenate([held_ids, np.broadcast_to(own, scores.shape)], 1), np.concatenate([held, scores], 1)
            order = np.lexsort((held_ids, -held), axis=1)[:, :top]
            held_ids, held = np.take_along_axis(held_ids, order, 1), np.take_along_axis(held, order, 1)
        row, col = np.nonzero(np.isfinite(held))
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(held_ids[row, col]), pa.array(held[row, col])], names=["probe", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))
    best = vectors.mapInArrow(run, "probe int, vec_id long, score double").withColumn("rank", rank).filter(F.col("rank") <= top)
    return vectors.join(F.broadcast(best.select("probe", "vec_id")), "vec_id").select("probe", "v").toArrow()


def measured(index: Index, q: np.ndarray, floor: np.ndarray, truth: pa.Table, lists: Lists, recall: float, replicate: float, most: int, least: int) -> Lists:
    """lists with the ratio of each band whose lists hold `recall` of the true neighbours in it, and the median distance to the closest list."""
    v = _matrix(truth.column("v").combine_chunks()) if truth.num_rows else np.zeros((0, q.shape[1]))
    probe = truth.column("probe").to_numpy()
    row, own, _ = assign(v, index, replicate, most)
    ratio, typical, widest = np.ones(len(index.bands)), np.zeros(len(index.bands)), np.ones(len(index.bands))
    level = index.band_of(np.sqrt((v * v).sum(1)))
    for k, band in enumerate(index.bands):
        at = slice(band.first, band.first + len(band.centroids))
        points = query_points(q, band)
        d = np.concatenate([np.where(lists.counts[at] > 0, distances(points[s], band.centroids), np.inf) for s in pieces_of(len(q), len(band.centroids))])
        near = d.min(1)
        typical[k] = float(np.median(near)) if np.isfinite(near).all() else 0.0
        needed, here = np.full(len(probe), np.inf), np.flatnonzero(level[row] == k)
        base = np.maximum(np.maximum(near, typical[k]), 1e-12)[probe[row[here]]]
        np.minimum.at(needed, row[here], d[probe[row[here]], own[here] - band.first] / base)
        needed = needed[level == k]
        if len(needed):
            ratio[k] = max(1.0, float(np.quantile(needed, recall, method="higher")) * (1 + 1e-9))
            widest[k] = max(1.0, float(needed.max()) * (1 + 1e-9))
    while True:
        lists = Lists(lists.counts, lists.homes, lists.norms, ratio, typical)
        found = np.zeros((len(q), index.lists), bool)
        found[chosen(q, floor, index, lists, least)] = True
        hit = np.zeros(len(probe), bool)
        np.logical_or.at(hit, row, found[probe[row], own])
        # what the walk over the graph finds has to hold as much
        if not len(probe) or hit.mean() >= recall - 1e-3 or (ratio >= widest).all():
            return lists
        ratio = np.minimum(ratio * 1.002, widest)


def valid_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and v of the rows that take part; single-precision components stay so until they are compared."""
    single = df.schema[embedding].dataType == ArrayType(FloatType(), df.schema[embedding].dataType.containsNull)
    v = F.col(f"`{embedding}`") if single else F.col(f"`{embedding}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _best(scores: np.ndarray, at: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: int, top: int, replicas: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and exact scores of the best of the postings `at` for one query; an id may have several postings."""
    ok = ids[at] != own
    scores, at = scores[ok], at[ok]
    if len(at) > top * replicas:
        cut = np.partition(scores, len(at) - top * replicas)[len(at) - top * replicas]
        near = scores >= cut - EXTRA * max(1.0, abs(cut))
        at = at[near]
    at = at[np.unique(ids[at], return_index=True)[1]]
    exact = (x[at] * q).sum(1)
    order = np.lexsort((ids[at], -exact))[:top]
    return ids[at][order], exact[order]


FOUND = "query_id long, vec_id long, score double, scanned long"
FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("scanned", pa.int64())])


def _search(rows: DataFrame, top: int, replicas: int) -> DataFrame:
    """rows (shard, list, lists, id, v): the postings of a shard by list, then its queries (list is null) with their
    lists. The best of each shard for each query, and how many postings it was compared with (beside its first row)."""

    def answers(piece: pa.RecordBatch, ids: np.ndarray, x: np.ndarray, edges: dict[int, tuple[int, int]]):
        q, own = _matrix(piece.column("v")), piece.column("id").to_numpy()
        lists = piece.column("lists")
        each = np.diff(lists.offsets.to_numpy())
        row, to = np.repeat(np.arange(len(q)), each), lists.flatten().to_numpy()
        scores = np.full((len(q), len(ids)), -np.inf)
        order = np.argsort(to, kind="stable")
        row, to = row[order], to[order]
        cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)], strict=False):
            low, high = edges.get(int(to[a]), (0, 0))
            scores[row[a:b], low:high] = q[row[a:b]] @ x[low:high].T
        out = [[], [], [], []]
        for i, v in enumerate(q):
            at = np.flatnonzero(scores[i] > -np.inf)
            if len(at):
                found, exact = _best(scores[i, at], at, ids, x, v, own[i], top, replicas)
                out[0].append(np.full(len(found), own[i]))
                out[1].append(found)
                out[2].append(exact)
                out[3].append(np.where(np.arange(len(found)) == 0, len(at), 0))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z), f.type) for z, f in zip(out, FOUND_SCHEMA, strict=True)], schema=FOUND_SCHEMA)

    def run(batches):
        key, parts, held = None, [], None
        for batch in batches:
            shards, asks = batch.column("shard").to_numpy(), np.asarray(batch.column("list").is_null())
            change = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                piece = batch.slice(a, b - a)
                if shards[a] != key:
                    key, parts, held = shards[a], [], None
                if not asks[a]:
                    parts.append((piece.column("id").to_numpy(), _matrix(piece.column("v")), piece.column("list").to_numpy()))
                    continue
                if not parts:
                    continue
                if held is None:
                    ids, x, own = (np.concatenate(z) for z in zip(*parts, strict=True))
                    lists, starts = np.unique(own, return_index=True)
                    held = ids, x, dict(zip(lists.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True), strict=True))
                for start in range(0, piece.num_rows, 256):
                    yield from answers(piece.slice(start, 256), *held)

    # nulls last: a shard's postings come before its queries
    return rows.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_last("list")).select("shard", "list", "lists", "id", "v").mapInArrow(run, FOUND)


def shards_of(counts: np.ndarray, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, cuts) of each list: neighbours share a shard; a list longer than shard_rows has `cuts` shards from its own on."""
    shard, cuts, at, held = np.zeros(len(counts), np.int32), np.maximum(1, -(-counts // shard_rows)).astype(np.int32), 0, 0
    for i, n in enumerate(counts.tolist()):
        if held and held + n > shard_rows:
            at, held = at + 1, 0
        shard[i] = at
        if cuts[i] > 1:
            at, held = at + int(cuts[i]), 0
        else:
            held += n
    return shard, cuts


def nearest(vectors: DataFrame, queries: DataFrame, scratch: Scratch, top: int = 20, list_rows: int = 16, shard_rows: int = 8192, fit_rows: int = 16, sample_rows: int = 1 << 18, most_lists: int = 1 << 16, anchors: int = 1024, replicate: float = 1.01, most_replicas: int = 3, recall: float = 0.94, probe: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score and scanned: the nearest of vectors (vec_id, v) for each of queries (vec_id, v), itself left out.

    Of rows that repeat an id, vectors and queries keep the same one: the least of the common length.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, scanned long")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    shapes = vectors.groupBy(F.size("v").alias("dim")).agg(F.count_distinct("vec_id").alias("n"), F.max(square).alias("norm")).orderBy(F.desc("n"), F.desc("dim")).first()
    if shapes is None:
        return empty
    once = lambda df: df.filter(F.size("v") == shapes.dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    # walks are work, though queries have few bytes: the number of their partitions is given
    vectors, queries = scratch.save(once(vectors), "vectors"), once(queries).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("vec_id"))
    lists = max(1, min(most_lists, round(shapes.n / list_rows)))
    sample = vectors.orderBy(F.xxhash64(F.lit("centroids"), "vec_id"), "vec_id").limit(min(sample_rows, fit_rows * lists)).toArrow()
    far = vectors.orderBy(square.desc(), "vec_id").limit(anchors).toArrow()
    held, held_ids = _matrix(far.column("v").combine_chunks()), far.column("vec_id").to_numpy()
    index = build_index(np.concatenate([_matrix(sample.column("v").combine_chunks()), held]), float(np.sqrt(shapes.norm)), lists)

    def count(batches):
        seen, norms = np.zeros((2, index.lists), np.int64), np.zeros(index.lists)
        for batch in batches:
            x = _matrix(batch.column("v"))
            row, own, home = assign(x, index, replicate, most_replicas)
            seen[0] += np.bincount(own, minlength=index.lists)
            seen[1] += np.bincount(own[home], minlength=index.lists)
            np.maximum.at(norms, own, np.sqrt((x * x).sum(1))[row])
        at = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at]), pa.array(norms[at])], names=["list", "n", "homes", "norm"])

    counts, homes, norms = np.zeros(index.lists, np.int64), np.zeros(index.lists, np.int64), np.zeros(index.lists)
    sums = vectors.mapInArrow(count, "list int, n long, homes long, norm double").groupBy("list").agg(F.sum("n").alias("n"), F.sum("homes").alias("homes"), F.max("norm").alias("norm"))
    for r in sums.collect():  # most_lists rows
        counts[r.list], homes[r.list], norms[r.list] = r.n, r.homes, r.norm
    shard, cuts = shards_of(counts, shard_rows)
    tried = queries.orderBy(F.xxhash64(F.lit("probe"), "vec_id"), "vec_id").limit(probe).toArrow()
    if not tried.num_rows:
        return empty
    asking, asking_ids = _matrix(tried.column("v").combine_chunks()), tried.column("vec_id").to_numpy()
    truth = true_nearest(vectors, asking_ids, asking, top)
    known = measured(index, asking, floors(asking, asking_ids, held, held_ids, top), truth, Lists(counts, homes, norms, np.ones(0), np.ones(0)), recall, replicate, most_replicas, top + 1)
    kind = vectors.schema["v"].dataType.simpleString()
    ddl, names = f"shard int, list int, lists array<int>, id long, v {kind}", ["shard", "list", "lists", "id", "v"]

    def post(batches):
        for batch in batches:
            row, own, _ = assign(_matrix(batch.column("v")), index, replicate, most_replicas)
            ids = batch.column("vec_id").to_numpy()[row]
            mixed = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            place = shard[own] + (mixed % cuts[own])
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(own.astype(np.int32)), pa.nulls(len(row), pa.list_(pa.int32())), pa.array(ids), batch.column("v").take(pa.array(row))], names=names)

    def ask(batches):
        for batch in batches:
            q = _matrix(batch.column("v"))
            row, own = chosen(q, floors(q, batch.column("vec_id").to_numpy(), held, held_ids, top), index, known, top + 1)
            # a list that is cut is asked for in each of its shards
            each = cuts[own].astype(np.int64)
            cut = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            row, own = np.repeat(row, each), np.repeat(own, each)
            place = shard[own] + cut
            order = np.lexsort((own, place, row))
            row, own, place = row[order], own[order], place[order]
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1])]) if len(row) else np.zeros(0, np.int64)
            taken = pa.ListArray.from_arrays(pa.array(np.append(new, len(own)).astype(np.int32)), pa.array(own.astype(np.int32)))
            at = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([pa.array(place[new].astype(np.int32)), pa.nulls(len(new), pa.int32()), taken, batch.column("vec_id").take(at), batch.column("v").take(at)], names=names)

    found = _search(vectors.mapInArrow(post, ddl).unionByName(queries.mapInArrow(ask, ddl)), top, most_replicas)
    every = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("scanned").alias("scanned"))
    own = Window.partitionBy("query_id")
    ranked = every.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "vec_id"))).withColumn("scanned", F.sum("scanned").over(own))
    return ranked.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score", "scanned")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    queries = vectors.filter(F.col("vec_id") % 20 == 0)
    return nearest(vectors, queries, Scratch(spark, "neighbours"))
