"""Toxicity: a linear classifier over character n-grams, their presence scaled by naive Bayes log-count ratios.

Texts are lower-cased and their n-grams of 3 to 6 characters hashed into 2**22 cells. From labelled documents a
distributed pass counts in how many toxic and clean ones each cell occurs; the log ratio r of the smoothed counts
scales the presence of a cell, cells whose ratio is significant become features, and a logistic regression on
r * presence gives the weights. Scoring looks each n-gram of the whole text up in a table of cells.

Bounds (parameters): at most `most_toxic` and `most_clean` labelled documents are learnt from, those with the
smallest hash of their id; at most `most_features` cells (65,536 at the utmost) become features. Everything that leaves the executors for
the driver is bounded by these.

Nulls: a null text counts as empty; a null label is no label; labels of one id that disagree count as toxic from a
half upwards; of several texts of one id the least is learnt from. An id that is null is held out. Without labels of both kinds the score is the share of toxic labels
(0 without any). Repeated rows are scored alike; an empty text has the score of the
bias alone; very long texts are gone through in stretches, whole. An empty table gives an empty result. Columns beside
id and text are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, held_out, map_arrow, slices, text_of

BITS = 22
ORDERS = (3, 4, 5, 6)
#: Bytes of text that are scored at once.
PIECE = 1 << 20


@dataclass(frozen=True)
class Model:
    cells: np.ndarray  # sorted
    weights: np.ndarray
    bias: float


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, a space around each, and where each text ends."""
    padded = [f" {(t or '').lower()} " for t in texts]
    return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([len(t) for t in padded])


def _grams(codes: np.ndarray):
    """For each order the cell of the n-gram at every position."""
    h = codes
    for n in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            return
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
            yield n, mixed >> np.uint32(32 - BITS)


def _hits(texts: list[str | None], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, cell), each once, of the cells of `known` that occur in a text."""
    codes, ends = _codes(texts)
    found, waiting = [], 0
    step = 1 << 18
    for at in range(0, len(codes), step):
        for n, cells in _grams(codes[at : at + step + max(ORDERS) - 1]):
            cells = cells[:step]
            where = np.flatnonzero(known[cells])
            text = np.searchsorted(ends, where + at, "right")
            inside = where + at + n <= ends[text]
            found.append((text[inside].astype(np.int64) << BITS) | cells[where[inside]])
            waiting += len(found[-1])
        if waiting > step:
            # the pairs of a long text are many times its cells
            found, waiting = [np.unique(np.concatenate(found))], 0
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


SUMS = pa.schema([("range", pa.int32()), ("clean", pa.int64()), ("toxic", pa.int64()), ("seen", pa.binary())])
SUMS_DDL = "range int, clean long, toxic long, seen binary"


def _sums(rows: DataFrame, ranges: int = 16) -> DataFrame:
    """By ranges of cells: in how many documents of each label a cell occurs, and how many there are of each.

    Tasks send their counts by ranges, and a range is added up in one task.
    """
    width = (1 << BITS) // ranges

    def run(batches):
        seen, n = np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                codes, _ = _codes([text])
                cells = np.unique(np.concatenate([np.empty(0, np.uint32), *(c for _, c in _grams(codes))]))
                seen[toxic, cells] += 1
                n[toxic] += 1
        for k in range(ranges):
            part = zlib.compress(np.ascontiguousarray(seen[:, k * width : (k + 1) * width]).tobytes(), 1)
            yield pa.RecordBatch.from_pydict({"range": [k], "clean": [n[0]], "toxic": [n[1]], "seen": [part]}, schema=SUMS)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(2 * width, np.int32)
        for part in table.column("seen").to_pylist():
            total += np.frombuffer(zlib.decompress(part), np.int32)
        sums = {c: [sum(table.column(c).to_pylist())] for c in ("clean", "toxic")}
        return pa.Table.from_pydict({"range": table.column("range")[:1].to_pylist(), **sums, "seen": [zlib.compress(total.tobytes(), 1)]}, schema=SUMS)

    return rows.mapInArrow(run, SUMS_DDL).groupBy("range").applyInArrow(add, SUMS_DDL)


def _count(rows: DataFrame, ranges: int = 16) -> tuple[np.ndarray, int, int]:
    """The sums as one table of all cells, to hold them against others; it takes 32 MB."""
    width = (1 << BITS) // ranges
    total, n = np.zeros((2, 1 << BITS), np.int32), [0, 0]
    for row in _sums(rows, ranges).collect():
        total[:, row.range * width : (row.range + 1) * width] = np.frombuffer(zlib.decompress(row.seen), np.int32).reshape(2, -1)
        n = [row.clean, row.toxic]
    return total, n[0], n[1]


def _features(rows: DataFrame, most_features: int, smooth: float, least_z: float, ranges: int = 16) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The cells whose log ratio is most significant, sorted, their ratios, and how many documents there are of each label.

    Ratios are made where a range is added up, and a range sends no more cells than all may have; so the driver holds
    no table of all cells.
    """
    width = (1 << BITS) // ranges
    schema = pa.schema([("range", pa.int32()), ("clean", pa.int64()), ("toxic", pa.int64()), ("cells", pa.binary()), ("ratio", pa.binary()), ("z", pa.binary())])

    def strongest(z: np.ndarray) -> np.ndarray:
        """Places of the most significant ratios, in their order; ties go to the smaller place."""
        return np.sort(np.argsort(-np.abs(z), kind="stable")[:most_features])

    def pick(batches):
        for batch in batches:
            for k, clean, toxic, part in zip(*(batch.column(c).to_pylist() for c in SUMS.names), strict=True):
                cells, ratio, z = np.empty(0, np.int64), np.empty(0), np.empty(0)
                if clean and toxic:
                    seen = np.frombuffer(zlib.decompress(part), np.int32).reshape(2, -1)
                    p, q = (seen[1] + smooth) / (toxic + 2 * smooth), (seen[0] + smooth) / (clean + 2 * smooth)
                    ratio = np.log(p / q)
                    z = ratio / np.sqrt((1 - p) / (toxic * p) + (1 - q) / (clean * q))
                    strong = np.flatnonzero((np.abs(z) >= least_z) & (seen.sum(0) >= 4))
                    strong = strong[strongest(z[strong])]
                    cells, ratio, z = strong + k * width, ratio[strong], z[strong]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((k, clean, toxic, cells.tobytes(), ratio.tobytes(), z.tobytes()), schema, strict=True)], schema=schema)

    # `ranges` rows
    found = sorted(_sums(rows, ranges).mapInArrow(pick, "range int, clean long, toxic long, cells binary, ratio binary, z binary").collect(), key=lambda row: row.range)
    cells, ratio, z = (np.frombuffer(b"".join(row[c] for row in found), kind) for c, kind in (("cells", np.int64), ("ratio", np.float64), ("z", np.float64)))
    best = strongest(z)
    return cells[best], ratio[best], *((found[0].clean, found[0].toxic) if found else (0, 0))


def _regress(at: np.ndarray, ends: np.ndarray, y: np.ndarray, ratio: np.ndarray, steps: int = 200, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio * presence by full gradients with momentum; weights are for presence.

    at: the features of all rows, those of row i before ends[i]. Rows are gone through in pieces, so memory beside
    `at` stays small.
    """
    n = len(y)
    starts = np.append(0, ends[:-1])
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(at), 1 << 19)), n))
    w, b = np.full(len(ratio), 0.1), 0.0
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, steps + 1):
        g, scaled, lean = np.zeros(len(ratio)), w * ratio, 0.0
        for low, high in zip(np.append(0, cuts[:-1]), cuts, strict=True):
            if low == high:
                continue
            part = at[starts[low] : ends[high - 1]]
            owner = np.repeat(np.arange(high - low), ends[low:high] - starts[low:high])
            z = np.bincount(owner, scaled[part], high - low) + b
            e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[low:high]) / n
            g += np.bincount(part, e[owner], len(ratio))
            lean += e.sum()
        g = np.append(g * ratio + ridge * w, lean)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w * ratio, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = 4000, most_clean: int = 8000, most_features: int = 8192, smooth: float = 1.0, least_z: float = 3.5, parts: int = 12, folds: int = 5) -> Model:
    """Learns from labels (doc_id, toxic) of docs (doc_id, text) outside the held-out fold."""
    one = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds)).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    key = F.xxhash64(F.lit("toxicity"), "doc_id")
    sample = one.filter("toxic = 1").orderBy(key, "doc_id").limit(most_toxic).unionByName(one.filter("toxic = 0").orderBy(key, "doc_id").limit(most_clean))
    # the sample has most_toxic + most_clean rows of two numbers at most
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    rows = Scratch(docs.sparkSession, "toxicity").save(rows.repartition(parts), "sample")
    cells, ratio, clean, toxic = _features(rows, most_features, smooth, least_z)
    if not clean or not toxic:
        p = toxic / max(1, clean + toxic)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))

    def run(batches):
        known = np.zeros(1 << BITS, bool)
        known[cells] = True
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                text, cell = _hits(part.column("text").to_pylist(), known)
                found = np.searchsorted(cells, cell).astype(np.uint16)
                n = np.bincount(text, minlength=part.num_rows).astype(np.int32)
                y = part.column("toxic").to_numpy().astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (y, found, n)], names=["toxic", "at", "n"])

    toxic_of, parts_of, ends = [], [], []
    for row in rows.mapInArrow(run, "toxic binary, at binary, n binary").collect():
        toxic_of.append(np.frombuffer(row.toxic, np.int8))
        parts_of.append(np.frombuffer(row.at, np.uint16))
        ends.append(np.frombuffer(row.n, np.int32))
    at, ends, y = np.concatenate(parts_of), np.cumsum(np.concatenate(ends)), np.concatenate(toxic_of).astype(float)
    # the rows that were collected are not held beside their copy
    del row, parts_of
    weights, bias = _regress(at, ends, y, ratio)
    return Model(cells, weights, float(bias))


def _scorer(model: Model):
    """The function from a batch with a text column to scores; made once in each task."""
    known = np.zeros(1 << BITS, bool)
    known[model.cells] = True

    def score(batch: pa.RecordBatch) -> np.ndarray:
        z = []
        for part in slices(batch, "text", PIECE):
            text, cell = _hits(part.column("text").to_pylist(), known)
            z.append(np.bincount(text, model.weights[np.searchsorted(model.cells, cell)], part.num_rows) + model.bias)
        return 1 / (1 + np.exp(-np.clip(np.concatenate(z), -500, 500)))

    return score


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def start():
        score = _scorer(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = score(batch)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=out)

        return step

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id, 5).alias("held_out"), text_of(text).alias("text"))
    return map_arrow(rows, start, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not call toxic, with all their columns."""

    def run(batches):
        score = _scorer(model)
        for batch in batches:
            # in pieces, so that no second copy of a batch of whole texts is held
            for part in slices(batch, "text", PIECE):
                if part.num_rows:
                    yield part.filter(pa.array(score(part) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
