"""Language-model scores: an interpolated bigram model in Elias-Fano tries, one for each shard of the contexts.

Counting. Documents are packed into blocks (token ids over a block's own word list, compressed), which are written
once. A block sends its distinct words with their counts in training documents to shards by hash; these add up, answer
each block, and give N, V and the hot words, those with more than a quarter of a shard's tokens (so at most four a
shard). Then it sends its distinct pairs to shards by context; a hot context is cut by a hash of the next word, so no
shard is larger than others whatever a word's share. A pair is sent once a block however often it occurs, and nothing
about the vocabulary goes to the driver but N, V and the hot words.

Model.  p(w | v) = g [max(0, c(v w) - D) / c(v) + D T(v) / c(v) u(w)] + (1 - g) u(w),   u(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),
absolute discounting, with T(v) the number of different words after v: a proper distribution. After a context not seen
in training, u(w). Of the weights in GRID, g is the one under which all training tokens are likeliest, each with its own
occurrence left out of the pair counts; documents are scored under all of them at once. The end of a text is a token,
and the context of a text's first word.

Trie. A shard builds one from its summed pairs (elias_fano.py): contexts by hash with a quantised log10 of the backoff
weight D T / c and monotone pointers to their successors; successors relative to their context, with the quantised
log10 of the discounted probability, all views of one memory map. It answers every block by a successor search between
a context's pointers. With a `model_path` the tries are written as well, and any reader can map them again. Quantising
to steps of 20 / 65535 moves a logarithm by 0.00015 at most.

Contexts are compared by 48-bit and successors by 40-bit hashes, words by their bytes in the word counts. Nulls count
as empty texts (their only token is the end); an id that is null is held out; repeated rows count as often as they
are there; a very long text stays whole in its block, which grows with it; columns beside id and text are ignored.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, held_out, text_of
from .elias_fano import Trie, restored

K = np.uint64(0x9E3779B97F4A7C15)
#: The hash of the end of a text.
END = np.uint64(0x5851F42D4C957F2D)
BLOCK, WORDS, PAIRS, MODEL, SUMS = range(5)
#: Weights of the bigram part to choose from.
GRID = (0.02, 0.1, 0.25, 0.4, 0.55, 0.7, 0.8, 0.9, 1.0)


# --- bytes ----------------------------------------------------------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: sorted hashes shrink by their equal upper bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def join_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def split_words(data: bytes, n: int) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n") if n else []


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(5)), np.uint64, len(words))


def as_context(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - Trie.CONTEXT_BITS)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * K
    return ((h >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int32)


def framed(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unframed(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8).tolist()
    ends = np.cumsum([8 + 8 * n, *sizes]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


#: Rows of every step: a kind, a shard, a block and what they carry.
ROW = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("v", pa.int64()), ("data", pa.binary())])
ROW_DDL = "kind int, shard int, block long, n long, v long, data binary"


def _rows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """One batch a row: some are large."""
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, ROW, strict=True)], schema=ROW)


def each_row(df: DataFrame, f: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    return df.mapInArrow(lambda batches: _rows(out for batch in batches for i in range(batch.num_rows) for out in f(batch.slice(i, 1).to_pylist()[0])), ROW_DDL)


def each_group(df: DataFrame, key: str, f: Callable[[list[dict]], Iterator], ddl: str = ROW_DDL, batches_of=_rows) -> DataFrame:
    """f over the rows of each value of key, by kind, shard and block."""

    def run(batches):
        def out():
            at, held = None, []
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    if row[key] != at and held:
                        yield from f(held)
                        held = []
                    at = row[key]
                    held.append(row)
            if held:
                yield from f(held)

        return batches_of(out())

    # the number is given, so that few bytes of much work are not put into one task
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key).sortWithinPartitions(key, "kind", "shard", "block").mapInArrow(run, ddl)


# --- blocks ---------------------------------------------------------------------------------------------------------


class _Ids(dict):
    """Word to its number in the order of first use; 0 is the end of a text."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self) + 1
        return found


def _blocks(block_bytes: int):
    def run(batches):
        state = None

        def close():
            ids, docs, null, held, parts, _ = state
            flat = np.concatenate(parts)
            digest = xxhash.xxh64_intdigest(flat.tobytes() + np.array(docs, np.int64).tobytes() + b"\n".join(list(ids)[:1000]))
            data = framed(pack(np.array(docs, np.int64)), pack(np.array(null, np.uint8)), pack(np.array(held, np.uint8)), pack(np.array([len(p) for p in parts], np.uint32)), pack(flat), join_words(list(ids)))
            return BLOCK, -1, int(np.uint64(digest).view(np.int64)), len(flat), len(ids), data

        def rows():
            nonlocal state
            for batch in batches:
                for text, doc, h in zip(batch.column("text").cast(pa.binary()), batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), strict=True):
                    if state is None:
                        state = [_Ids(), [], [], [], [], 0]
                    text = text.as_py()
                    words = text.lower().split()
                    state[1].append(doc or 0)
                    state[2].append(doc is None)
                    state[3].append(h)
                    state[4].append(np.append(np.fromiter(map(state[0].__getitem__, words), np.uint32, len(words)), np.uint32(0)))
                    state[5] += len(text)
                    if state[5] >= block_bytes:
                        yield close()
                        state = None
            if state is not None:
                yield close()

        return _rows(rows())

    return run


class Block:
    """An opened block: its documents, tokens, words and distinct pairs."""

    def __init__(self, row: dict):
        docs, null, held, sizes, ids, words = unframed(row["data"])
        self.block, self.ids, self.sizes = row["block"], unpack(ids, np.uint32), unpack(sizes, np.uint32)
        self.docs, self.null, self.held = unpack(docs, np.int64), unpack(null, np.uint8) > 0, unpack(held, np.uint8) > 0
        self.words = split_words(words, row["v"])
        self.hashes = np.append(END, hashed(self.words))
        self.train = np.repeat(~self.held, self.sizes)
        self.before = np.append(np.uint32(0), self.ids[:-1])  # the last token of the text before is its end, id 0

    def counts(self) -> np.ndarray:
        return np.bincount(self.ids[self.train], minlength=len(self.hashes))

    def word_shards(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Words in the order of their shards, and the shards where they change hands. The end of a text counts in shard 0."""
        own = shard_of(self.hashes, shards)
        own[0] = 0
        order = np.argsort(own, kind="stable")
        return order, own[order]

    def pairs(self, shards: int, hot: Hot) -> tuple[np.ndarray, ...]:
        """For the distinct pairs, sorted by shard, context and word: shard, context, hash of the word, number of the
        context; and for each token the place of its pair."""
        n = len(self.hashes)
        key, at = np.unique(self.before.astype(np.uint64) * np.uint64(n) + self.ids, return_inverse=True)
        first, second = (key // np.uint64(n)).astype(np.int64), (key % np.uint64(n)).astype(np.int64)
        x, w = as_context(self.hashes), (self.hashes >> np.uint64(64 - Trie.BITS))[second]
        # contexts, and the parts of hot ones, are put in order first; then a pair is one number
        part, own = np.zeros(n, np.uint64), first.copy()
        cut = np.flatnonzero(hot.at(x)[first] >= 0)
        if len(cut):
            parts = hot.part(x[first[cut]], w[cut])
            both, own_cut = np.unique(np.stack([first[cut].astype(np.uint64), parts]), axis=1, return_inverse=True)
            own[cut] = n + own_cut.ravel()
            x, part = np.append(x, x[both[0].astype(np.int64)]), np.append(part, both[1])
        shard = shard_of(x + part * K, shards)
        rank = np.empty(len(x), np.uint64)
        order = np.lexsort((part, x, shard))
        rank[order] = np.arange(len(x), dtype=np.uint64)
        order = np.argsort(rank[own] << np.uint64(Trie.BITS) | w, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return shard[own[order]], x[own[order]], w[order], first[order], place[at]


class Hot:
    """Words whose contexts are cut: their hashes, sorted, counts and parts."""

    def __init__(self, x: np.ndarray, count: np.ndarray, most: int):
        self.x, self.count, self.parts = x, count, -(-count // most)
        self.types = np.zeros(len(x), np.int64)

    def at(self, x: np.ndarray) -> np.ndarray:
        """The place of each hash among the hot words, -1 for others."""
        if not len(self.x):
            return np.full(len(x), -1)
        place = np.minimum(np.searchsorted(self.x, x), len(self.x) - 1)
        return np.where(self.x[place] == x, place, -1)

    def part(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        at = self.at(x)
        out = np.zeros(len(x), np.uint64)
        cut = np.flatnonzero(at >= 0)
        out[cut] = 1 + ((w[cut] * K) >> np.uint64(33)) % self.parts[at[cut]].astype(np.uint64)
        return out


# --- words ----------------------------------------------------------------------------------------------------------


def _word_messages(shards: int):
    def run(row: dict):
        b = Block(row)
        counts = b.counts().astype(np.uint32)
        order, own = b.word_shards(shards)
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for low, high in zip(cuts, np.r_[cuts[1:], len(own)], strict=True):
            at = order[low:high]
            # the end of a text is no word; it counts under an empty name
            yield WORDS, int(own[low]), b.block, len(at), None, framed(join_words([b.words[i - 1] if i else b"" for i in at.tolist()]), pack(counts[at]))

    return run


def _word_totals(most: int):
    def run(rows: list[dict]):
        total: dict[bytes, int] = {}
        for r in rows:
            words, counts = unframed(r["data"])
            for w, c in zip(split_words(words, r["n"]), unpack(counts, np.uint32).tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        for r in rows:
            words = split_words(unframed(r["data"])[0], r["n"])
            yield WORDS, r["shard"], r["block"], len(words), None, pack(np.fromiter(map(total.__getitem__, words), np.uint64, len(words)))
        hot = sorted(((int(END) if not w else xxhash.xxh64_intdigest(w, 5)) >> (64 - Trie.CONTEXT_BITS), c) for w, c in total.items() if c > most)
        yield SUMS, rows[0]["shard"], 0, sum(total.values()), sum(c > 0 for c in total.values()), np.array(hot, np.uint64).tobytes()

    return run


# --- pairs ----------------------------------------------------------------------------------------------------------


def _pair_messages(shards: int, hot: Hot):
    def run(row: dict):
        b = Block(row)
        own, x, w, _, place = b.pairs(shards, hot)
        counts = np.bincount(place[b.train], minlength=len(x)).astype(np.uint32)
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for low, high in zip(cuts, np.r_[cuts[1:], len(own)], strict=True):
            at = np.flatnonzero(np.r_[True, x[low + 1 : high] != x[low : high - 1]])
            yield PAIRS, int(own[low]), b.block, int(high - low), None, framed(pack(x[low:high][at]), pack(np.diff(np.append(at, high - low)).astype(np.uint32)), pack(w[low:high]), pack(counts[low:high]))

    return run


def _tries(discount: float, hot: Hot, keep: bool):
    """Adds up the pairs of a shard, builds its trie and answers the blocks from it; keep: the trie is a row as well."""

    def run(rows: list[dict]):
        asked = []
        for r in rows:
            x, each, w, _ = unframed(r["data"])
            asked.append((unpack(x, np.uint64), unpack(each, np.uint32).astype(np.int64), unpack(w, np.uint64)))
        x, w = np.concatenate([np.repeat(a, n) for a, n, _ in asked]), np.concatenate([a for _, _, a in asked])
        c = np.concatenate([unpack(unframed(r["data"])[3], np.uint32) for r in rows]).astype(np.int64)
        order = np.lexsort((w, x))
        sx, sw = x[order], w[order]
        new = np.ones(len(order), bool)
        new[1:] = (sx[1:] != sx[:-1]) | (sw[1:] != sw[:-1])
        at = np.flatnonzero(new)
        question = np.empty(len(order), np.int64)
        question[order] = np.cumsum(new) - 1
        asked_x, asked_w, c = sx[at], sw[at], np.add.reduceat(c[order], at)
        seen = c > 0
        x, w, c = asked_x[seen], asked_w[seen], c[seen]
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
        contexts, starts = x[first], np.append(first, len(x))
        types, total = np.diff(starts), np.add.reduceat(c, first) if len(first) else first
        cut = hot.at(contexts)
        # of a hot context only a part of the successors is here
        total = np.where(cut >= 0, hot.count[cut] if len(hot.x) else 0, total)
        log10 = np.log10((c - discount) / np.repeat(total, types))
        with np.errstate(divide="ignore"):
            backoff = np.log10(discount * types / total)
        trie = Trie(buffer := Trie.build(contexts, starts, w, log10, backoff))
        # a question that several blocks ask is answered once
        asked_first = np.flatnonzero(np.r_[True, asked_x[1:] != asked_x[:-1]])
        rank = np.repeat(trie.context(asked_x[asked_first]), np.diff(np.append(asked_first, len(asked_x))))
        answer = trie.find(rank, asked_w)
        weight = np.where(rank >= 0, trie.backoff[rank] if trie.contexts.n else 0, 0).astype(np.uint16)
        low = 0
        for r, (_, _, word) in zip(rows, asked, strict=True):
            own, low = question[low : low + len(word)], low + len(word)
            yield PAIRS, r["shard"], r["block"], len(word), None, framed(pack(answer[own]), pack(weight[own]))
        if keep:
            yield MODEL, rows[0]["shard"], 0, len(contexts), len(w), bytes(buffer)
        known = np.flatnonzero(cut >= 0)
        yield SUMS, rows[0]["shard"], 0, None, None, np.array([contexts[known], types[known].astype(np.uint64)]).T.tobytes()

    return run


# --- scores ---------------------------------------------------------------------------------------------------------

#: A row a document, with its score under each weight; a row without `scores` has the training likelihoods of a block.
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("scores", pa.list_(pa.float64())), ("fit", pa.list_(pa.float64()))])
SCORED_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, scores array<double>, fit array<double>"


def _scores(n: int, v: int, word_shards: int, pair_shards: int, discount: float, hot: Hot):
    def run(rows: list[dict]):
        b = Block(next(r for r in rows if r["kind"] == BLOCK))
        # both come by shard, as the block sent them
        order, _ = b.word_shards(word_shards)
        counts = np.zeros(len(b.hashes), np.uint64)
        counts[order] = np.concatenate([unpack(r["data"], np.uint64) for r in rows if r["kind"] == WORDS])
        found = [[unpack(p, np.uint16) for p in unframed(r["data"])] for r in rows if r["kind"] == PAIRS]
        log10, weight = (np.concatenate(z) for z in zip(*found, strict=True))
        _, x, _, context, place = b.pairs(pair_shards, hot)
        u = (counts.astype(np.float64) + 0.1) / (n + 0.1 * (v + 1))
        lower = np.where(weight > 0, 10 ** restored(weight.astype(np.float64)), 1.0)
        at = hot.at(x)
        cut = np.flatnonzero(at >= 0)
        lower[cut] = discount * hot.types[at[cut]] / hot.count[at[cut]]
        # a context without training counts has no weight of its own
        lower[counts[context] == 0] = 1.0
        own = np.where(log10 > 0, 10 ** restored(log10.astype(np.float64)), 0.0)
        u_token = u[b.ids]
        starts = (np.cumsum(b.sizes) - b.sizes).astype(np.int64)
        total = lambda z: np.add.reduceat(z, starts)
        # training tokens with their own occurrence left out: pair count c of a context's m, after T different words
        m = counts[context].astype(np.float64)
        c = np.rint(own * m + discount * (own > 0))
        left = np.maximum(0.0, c - 1 - discount) / np.maximum(1.0, m - 1)
        rest = np.where(m > 1, (lower * m - discount * (c == 1)) / np.maximum(1.0, m - 1), 1.0)
        # g a + (g b + 1 - g) u  is  u + g (a + (b - 1) u)
        gain = own[place] + (lower[place] - 1) * u_token
        at, u_train = place[b.train], u_token[b.train]
        gain_train = left[at] + (rest[at] - 1) * u_train
        ten = 1 / np.log(10)
        scores = [total(np.log(u_token + g * gain)) * ten for g in GRID]
        fit = [float(np.log(u_train + g * gain_train).sum() * ten) for g in GRID]
        flat = pa.array(np.stack(scores, axis=1).ravel())
        scores = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(GRID)), pa.int32()), flat)
        none = pa.nulls(len(b.sizes), SCORED.field("fit").type)
        yield pa.RecordBatch.from_arrays([pa.array(b.docs, mask=b.null), pa.array(b.held), pa.array(b.sizes.astype(np.int64)), pa.array(total((counts[b.ids] > 0).astype(np.int64))), pa.array(np.full(len(b.sizes), n)), pa.array(total(np.log10(u_token))), scores, none], schema=SCORED)
        yield pa.RecordBatch.from_pylist([{"fit": fit}], schema=SCORED)

    return run


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 10, block_bytes: int = 4 << 20, shard_tokens: int = 1 << 19, discount: float = 0.75, model_path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    model_path: a folder that gets the tries, as Parquet rows (shard, contexts, pairs, trie).
    """
    scratch = Scratch(docs.sparkSession, "language-model")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), held_out(doc_id, folds).alias("held_out"), text_of(text).alias("text"))
    packed = scratch.save(rows.mapInArrow(_blocks(block_bytes), ROW_DDL), "blocks")
    shards = max(1, -(-int(packed.agg(F.sum("n")).first()[0] or 0) // shard_tokens))
    words = scratch.save(each_group(each_row(packed, _word_messages(shards)), "shard", _word_totals(shard_tokens // 4)), "words")
    n = v = 0
    hot = [np.zeros((0, 2), np.uint64)]
    for r in words.filter(F.col("kind") == SUMS).toLocalIterator():  # a row a shard, at most four hot words each
        n, v = n + r.n, v + r.v
        hot.append(np.frombuffer(r.data, np.uint64).reshape(-1, 2))
    hot = np.concatenate(hot)
    hot = hot[np.argsort(hot[:, 0])]
    hot = Hot(hot[:, 0], hot[:, 1].astype(np.int64), max(1, shard_tokens // 4))
    model = scratch.save(each_group(each_row(packed, _pair_messages(shards, hot)), "shard", _tries(discount, hot, model_path is not None)), "model")
    for r in model.filter(F.col("kind") == SUMS).select("data").toLocalIterator():  # the hot words of each shard
        part = np.frombuffer(r.data, np.uint64).reshape(-1, 2)
        np.add.at(hot.types, hot.at(part[:, 0]), part[:, 1].astype(np.int64))
    if model_path is not None:
        model.filter(F.col("kind") == MODEL).select("shard", F.col("n").alias("contexts"), F.col("v").alias("pairs"), F.col("data").alias("trie")).write.parquet(model_path)
    every = packed.unionByName(words.filter(F.col("kind") == WORDS)).unionByName(model.filter(F.col("kind") == PAIRS))
    scored = scratch.save(each_group(every, "block", _scores(n, v, shards, shards, discount, hot), SCORED_DDL, iter), "scored")
    fit = scored.filter("scores is null").agg(*[F.sum(F.col("fit")[k]).alias(str(k)) for k in range(len(GRID))]).first()
    best = max(range(len(GRID)), key=lambda k: fit[k]) if fit[0] is not None else 0
    return scored.filter("scores is not null").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("scores")[best].alias("score"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
