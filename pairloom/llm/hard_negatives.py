"""Hard negatives by bit-sliced integer products: the rows most like an anchor that carry another label.

Components become whole numbers. A row's components are read as bit planes in two's complement, most significant first;
after some planes a component lies between its known bits followed by zeros and by ones, so an anchor's product with the
row lies in

    [known + (2^s - 1) * (sum of the anchor's negative components), known + (2^s - 1) * (sum of its positive ones)]

with s planes to go. Each plane halves these intervals. A candidate is dropped once its interval misses every window
that the anchor asks about, or once `keep` others, sure to be in the window, have lower ends above its upper end; the
last plane leaves exact products. Planes are taken by matrix products while most pairs are alive, then pair by pair.

Anchors are part of the question and meet all rows, in blocks: a task has one block of anchors and one of rows, both
bounded and dealt by a hash of the id, so hot labels and copies don't gather. Rows are sent once for each block of
`anchor_rows` anchors, anchors once for each block of `block_rows` rows. A task returns at most `keep` rows for each
anchor and window, which rank the same as in the whole table. First positives are found, by a window without bounds,
then negatives in the windows that the positives' scores set.

Rows take no part where id, label, vector or a component is null, or a component not finite. Rows that repeat an id count
once, the one with the least label and then components. A shorter vector is filled up with zeros; one without components
has score 0 with all. Ties go to the smaller id. Anchors without positives, or positives without a row in their window,
have no result; an empty table has none. Scores that may leave 64 bits raise an error. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Anchors that meet a block of rows at once.
CHUNK = 256
#: Pairs whose bits are gathered at once.
PAIRS = 1 << 15
LEAST, MOST = -(1 << 62), 1 << 62


def whole_vectors(vector: str, factor: int = 256) -> Column:
    """The components times factor, rounded down; null for vectors that are null or hold null or non-finite ones."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * factor)))


# --- the products of a block ----------------------------------------------------------------------------------------


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, LEAST where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), LEAST, values.dtype)
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k]


def _kth_of(group: np.ndarray, values: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th largest value of each of n groups, LEAST where there are fewer."""
    order = np.lexsort((-values, group))
    g, out = group[order], np.full(n, LEAST, values.dtype)
    place = np.arange(len(g)) - np.searchsorted(g, g)
    out[g[place == k - 1]] = values[order][place == k - 1]
    return out


class Planes:
    """The bit planes of whole-number rows."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.bits = 1 + max((int(x).bit_length() for x in ((~rows).max(initial=0), rows.max(initial=0))), default=0)

    def plane(self, s: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return (self.rows[at] >> s) & 1

    def weight(self, s: int) -> int:
        return -(1 << s) if s == self.bits - 1 else 1 << s


def sifted(planes: Planes, anchors: np.ndarray, may: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs in `may` that can be among the first `keep` of a window [low, high] of their anchor.

    low and high have a column for each window. Every pair that belongs to a window's first `keep` is returned, and
    ties with the last of them.
    """
    total = int(np.abs(anchors).sum(1).max(initial=0)) << planes.bits
    if total >= LEAST * -1:
        raise OverflowError("scores may not fit 64 bits")
    up, down = np.where(anchors > 0, anchors, 0).sum(1), np.where(anchors < 0, anchors, 0).sum(1)
    # sums of floats are exact as long as no partial sum can leave the mantissa
    kind = np.float32 if total >> planes.bits < 1 << 24 else np.float64 if total >> planes.bits < 1 << 53 else np.int64
    flat, score, alive = anchors.astype(kind), np.zeros(may.shape, np.int64), may
    s = planes.bits
    while s and 8 * np.count_nonzero(alive) > alive.size:
        s -= 1
        score += planes.weight(s) * (flat @ planes.plane(s).T.astype(kind)).astype(np.int64)
        slack = (1 << s) - 1
        if s and slack * int((up - down).min()) > int(score.max()) - int(score.min()):
            continue  # the intervals are wider than all scores are apart
        lo, hi = score + (slack * down)[:, None], score + (slack * up)[:, None]
        useful = np.zeros_like(alive)
        for a, b in zip(low.T[:, :, None], high.T[:, :, None], strict=True):
            possible = alive & (hi >= a) & (lo <= b)
            floor = _kth(np.where(possible & (lo >= a) & (hi <= b), lo, LEAST), keep)
            useful |= possible & (hi >= floor[:, None])
        alive = useful
    i, j = np.nonzero(alive)
    score = score[i, j]
    while s and len(i):
        s -= 1
        for at in range(0, len(i), PAIRS):
            part = slice(at, at + PAIRS)
            score[part] += planes.weight(s) * np.einsum("pd,pd->p", anchors[i[part]], planes.plane(s, j[part]))
        slack = (1 << s) - 1
        lo, hi, useful = score + slack * down[i], score + slack * up[i], np.zeros(len(i), bool)
        for a, b in zip(low.T, high.T, strict=True):
            possible = (hi >= a[i]) & (lo <= b[i])
            sure = possible & (lo >= a[i]) & (hi <= b[i])
            useful |= possible & (hi >= _kth_of(i[sure], lo[sure], len(anchors), keep)[i])
        i, j, score = i[useful], j[useful], score[useful]
    return i, j, score


def first_of_windows(ids: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """(anchor, window, row, score): the first `keep` pairs of each window, high scores first, then small ids."""
    out = []
    for w in range(low.shape[1]):
        at = np.flatnonzero((score >= low[i, w]) & (score <= high[i, w]))
        at = at[np.lexsort((ids[j[at]], -score[at], i[at]))]
        at = at[np.arange(len(at)) - np.searchsorted(i[at], i[at]) < keep]
        out.append((i[at], np.full(len(at), w), j[at], score[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# --- blocks over the table ------------------------------------------------------------------------------------------


FOUND = pa.schema([("anchor_id", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists without nulls as rows filled up with zeros, and their lengths."""
    lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), max(1, sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out, sizes


def _cell(same: bool, keep: int):
    def search(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        ids = t.column("vec_id").to_numpy()
        label = np.unique(t.column("label").to_numpy(), return_inverse=True)[1]
        at, own = np.flatnonzero(asks), np.flatnonzero(~asks)
        q = _matrix(t.column("q"))[0]
        (low, n), (high, _) = (_matrix(t.column(c).take(pa.array(at))) for c in ("low", "high"))
        # a window that an anchor does not have holds nothing
        none = np.arange(low.shape[1])[None, :] >= n[:, None]
        low, high = np.where(none, MOST, low), np.where(none, LEAST, high)
        planes, out = Planes(q[own]), []
        for k in range(0, len(at), CHUNK):
            a = at[k : k + CHUNK]
            alike = label[a][:, None] == label[own][None, :]
            may = alike & (ids[a][:, None] != ids[own][None, :]) if same else ~alike
            some = slice(k, k + CHUNK)
            i, j, score = sifted(planes, q[a], may, low[some], high[some], keep)
            i, w, j, score = first_of_windows(ids[own], i, j, score, low[some], high[some], keep)
            out.append((ids[a][i], w.astype(np.int32), ids[own][j], score))
        found = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, FOUND, strict=True)], schema=FOUND)

    return search


def nearest_in_windows(anchors: DataFrame, rows: DataFrame, same: bool, keep: int, anchor_blocks: int, row_blocks: int) -> DataFrame:
    """anchor_id, window, rank, vec_id and score: the first `keep` rows of each window of anchors.

    rows have vec_id, label and q; anchors also low and high, the bounds of their windows. same: rows of the anchor's
    label, else of any other.
    """
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    bare = F.lit(None).cast("array<long>")
    ask = anchors.select(block(anchor_blocks).alias("i"), every(row_blocks).alias("j"), F.lit(True).alias("asks"), "vec_id", "label", "q", "low", "high")
    own = rows.select(every(anchor_blocks).alias("i"), block(row_blocks).alias("j"), F.lit(False).alias("asks"), "vec_id", "label", "q", bare.alias("low"), bare.alias("high"))
    found = ask.unionByName(own).groupBy("i", "j").applyInArrow(_cell(same, keep), "anchor_id long, window int, vec_id long, score long")
    rank = F.expr("row_number() over (partition by anchor_id, window order by score desc, vec_id)")
    return found.select("*", rank.alias("rank")).filter(F.col("rank") <= keep)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, anchor_rows: int = 16384, block_rows: int = 8192) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    vectors have vec_id, label and q (whole numbers, null for rows that take no part). For each of the first `positives`
    rows of an anchor's label: the first `negatives` rows of other labels whose score is `low` to `high` hundredths of
    the positive's.
    """
    scratch = Scratch(vectors.sparkSession, "hard-negatives")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "q").filter("vec_id is not null and label is not null and q is not null")
    rows = scratch.save(rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("x")).select("vec_id", "x.label", "x.q"), "rows")
    anchors = rows.filter(is_anchor)
    n, asked = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    blocks = max(1, -(-asked // anchor_rows)), max(1, -(-n // block_rows))
    open_ended = anchors.select("*", F.array(F.lit(LEAST)).alias("low"), F.array(F.lit(MOST)).alias("high"))
    best = scratch.save(nearest_in_windows(open_ended, rows, True, positives, *blocks).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # equal scores set equal windows
    windows = best.groupBy("anchor_id").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))
    least = F.transform("scores", lambda p: F.ceil(p * low / F.lit(100).cast("decimal(3,0)")).cast("long"))
    most = F.transform("scores", lambda p: F.floor(p * high / F.lit(100).cast("decimal(3,0)")).cast("long"))
    asking = anchors.join(windows, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "q", least.alias("low"), most.alias("high"))
    found = nearest_in_windows(asking, rows, False, negatives, *blocks).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    scored = windows.select("anchor_id", F.posexplode("scores").alias("window", "positive_score"))
    told = found.join(scored, ["anchor_id", "window"]).join(best, ["anchor_id", "positive_score"])
    return told.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), whole_vectors("embedding").alias("q")), F.col("vec_id") % 100 == 0)


NEGATIVES_SQL = """
WITH held AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM held a JOIN held b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS "rank", s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM pos p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT * FROM neg WHERE "rank" <= 5
"""
