"""Repeated windows of bytes, by depth-limited radix passes over suffixes.

Every byte covered by a `width`-byte string that starts elsewhere too is found. Suffixes are only ordered as deep as
`width` bytes, most significant digit first, and a suffix that is alone after a digit leaves at once:

  digit 1  the window's anchor: the 32 bytes in it with the smallest hash, the leftmost of equals. Equal windows have
           equal anchors at equal places, and neighbouring windows share an anchor, so a run of windows (a block)
           takes one row. Blocks that are wholly equal are repeated throughout; anchors of one block only are unique.
  digits   blocks that share an anchor and differ are cut into their windows; passes over 40 bytes at a time refine
  2 to 6   the groups down to `width` bytes. Groups that hold two windows or more are exactly the repeated windows.

Digits are compared by 64-bit hashes (an anchor and five digits a window, two a block), never by position or owner.
In a block the repeated windows lie less than `width` apart, so they cover one stretch of bytes, from the first to the
end of the last one.

Skew: equal blocks of a task are counted before they are sent, and of an anchor that has several blocks in a task only
one is asked about, so an anchor gets two rows from a task at most. Anchors with more than `hot_blocks` differing
blocks are dealt out window by window instead, again counted within tasks first.

Matches never cross documents. Nulls count as empty texts. Repeated rows (same id and text) repeat each other: they are
covered as a whole, and one of them is read for the others.
Columns beside id and text are ignored. Empty tables give empty results. Texts of any length are read whole, in
overlapping stretches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, text_of

WIDTH = 200
ANCHOR = 32
DIGIT = 40
#: Bytes hashed at once, and blocks held before they are counted and sent.
PIECE = 1 << 20
HELD = 1 << 20
PLACE = 24
ASK, DIRECT, COVERED = 0, 1, 2
#: Tasks that the blocks of one anchor are dealt to when hot anchors are marked.
SALTS = 32

K = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
LETTERS = (_LETTERS ^ (_LETTERS >> np.uint64(29))) * K


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = a >> np.uint64(31)
    c ^= a
    c *= K
    c += b
    return c


def levels(data: np.ndarray, most: int = 128) -> dict[int, np.ndarray]:
    """Hashes of the 1, 2, 4 ... `most` bytes from each position."""
    out, w = {1: LETTERS[data]}, 1
    while w < most:
        out[2 * w] = mix(out[w][:-w], out[w][w:]) if len(out[w]) > w else out[w][:0]
        w *= 2
    return out


def blocks(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor, block hash, first start and last start of each run of windows with one anchor and one owner."""
    lv = levels(data)
    none = np.empty(0, np.uint64)
    if len(data) < WIDTH:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    anchors = lv[ANCHOR]
    low = mix(anchors, anchors >> np.uint64(17))
    low = ((low >> np.uint64(PLACE)) << np.uint64(PLACE)) | np.arange(len(low), dtype=np.uint64)
    w, span = 1, WIDTH - ANCHOR + 1
    while 2 * w <= span:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    if w < span:
        low = np.minimum(low[: len(low) - (span - w)], low[span - w :])
    place = (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    at = np.flatnonzero(owner[: len(place)] == owner[WIDTH - 1 :])
    if not len(at):
        return none, none, none.astype(np.int64), none.astype(np.int64)
    place = place[at]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    first, last, anchor = at[new], at[np.r_[new[1:] - 1, len(at) - 1]], place[new]
    whole = lambda i: mix(mix(lv[128][i], lv[64][i + 128]), lv[8][i + 192])
    shape = ((anchor - first) * 512 + (anchor - last)).astype(np.uint64)
    return anchors[anchor], mix(mix(whole(first), whole(last)), shape), first, last


def stretches(texts: list[bytes]):
    """(index of text, offset, bytes) in pieces of about PIECE bytes; stretches of a longer text overlap by WIDTH - 1."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WIDTH + 1), 4 * PIECE) if len(t) >= WIDTH else ():
            part = t[at : at + 4 * PIECE + WIDTH - 1]
            held.append((i, at, part))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


FIRST = pa.schema([("kind", pa.int32()), ("route", pa.int64()), ("m", pa.int64()), ("h", pa.int64()), ("key", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("many", pa.bool_()), ("multi", pa.bool_())])
FIRST_DDL = "kind int, route long, m long, h long, key long, s int, n int, many boolean, multi boolean"


def _first(m, h, key, s, n) -> pa.RecordBatch:
    """What a task sends of its blocks: rows to ask about, blocks known to contend, stretches known to be covered."""
    order = np.lexsort((h, m))
    m, h, key, s, n = m[order], h[order], key[order], s[order], n[order]
    new_m = np.r_[True, m[1:] != m[:-1]]
    new_h = new_m | np.r_[True, h[1:] != h[:-1]]
    block = np.cumsum(new_h) - 1
    group = np.cumsum(new_m) - 1
    many = np.bincount(block)[block] > 1
    multi = np.bincount(group, new_h)[group] > 1
    ask = new_m
    direct = new_h & ~new_m
    # the first blocks of a contended anchor are asked about and the others compared at once; copies are covered now
    covered = many & ~ask
    ck, cs, ce = merge(key[covered], s[covered], s[covered] + n[covered] + WIDTH)
    both = lambda x, fill: np.concatenate([x[ask], x[direct], np.full(len(ck), fill, x.dtype)])
    kind = np.repeat(np.array([ASK, DIRECT, COVERED], np.int32), [ask.sum(), direct.sum(), len(ck)])
    keys = np.concatenate([key[ask], key[direct], ck])
    return pa.RecordBatch.from_arrays(
        [pa.array(kind), pa.array(np.where(kind == ASK, both(m.view(np.int64), 0), keys)), pa.array(both(m.view(np.int64), 0)), pa.array(both(h.view(np.int64), 0)), pa.array(keys), pa.array(np.concatenate([s[ask], s[direct], cs]).astype(np.int32)), pa.array(np.concatenate([n[ask], n[direct], ce - cs - WIDTH]).astype(np.int32)), pa.array(both(many, False)), pa.array(both(multi, False))],
        schema=FIRST,
    )


def merge(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unites stretches of one key that touch."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order].astype(np.int64)
    new = np.r_[True, key[1:] != key[:-1]]
    # the furthest end so far of the same key: keys are ranked so that a later key is beyond every end before it
    lift = (np.cumsum(new) - 1) * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + lift)
    new |= np.r_[True, (start + lift)[1:] > far[:-1]]
    at = np.flatnonzero(new)
    return key[at], start[at], (far - lift)[np.r_[at[1:] - 1, len(key) - 1]]


def _map_blocks(batches):
    held, size = [], 0
    for batch in batches:
        texts, keys = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("key").to_numpy()
        for parts in stretches(texts):
            data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
            long = np.array([len(p[2]) for p in parts])
            index = np.repeat(np.arange(len(parts)), long)
            m, h, first, last = blocks(data, index)
            if not len(m):
                continue
            own = index[first]
            offset = (np.array([p[1] for p in parts]) - (np.cumsum(long) - long))[own]
            held.append((m, h, keys[np.array([p[0] for p in parts])[own]], first + offset, last - first))
            size += len(m)
            if size >= HELD:
                yield _first(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield _first(*map(np.concatenate, zip(*held, strict=True)))


SECOND = pa.schema([("covered", pa.bool_()), ("m", pa.int64()), ("key", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])


def whole_groups(batches, column: str):
    """Batches sorted by a column, cut so that no value's rows lie in two."""
    carry = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
        values = table.column(column).to_numpy()
        cut = int(np.searchsorted(values, values[-1], "left"))
        if cut:
            yield table.slice(0, cut).combine_chunks()
        carry = table.slice(cut).combine_chunks()
    if carry is not None and carry.num_rows:
        yield carry


def _decide(batches):
    """Settles the anchors of a partition, which come sorted."""
    for t in whole_groups(batches, "m"):
        col = {c: t.column(c).to_numpy() for c in t.column_names}
        kind = col["kind"]
        a = np.flatnonzero(kind == ASK)
        a = a[np.lexsort((col["h"][a], col["m"][a]))]
        m, h = col["m"][a], col["h"][a]
        new_m = np.r_[True, m[1:] != m[:-1]][: len(a)]
        new_h = (new_m | np.r_[True, h[1:] != h[:-1]][: len(a)]) if len(a) else new_m
        block, group = np.cumsum(new_h) - 1, np.cumsum(new_m) - 1
        if len(a):
            repeated = np.bincount(block, 1 + col["many"][a])[block] > 1
            contended = (np.bincount(group, new_h)[group] > 1) | (np.bincount(group, col["multi"][a])[group] > 0)
        else:
            repeated = contended = np.empty(0, bool)
        cover = np.r_[a[repeated], np.flatnonzero(kind == COVERED)]
        compare = np.r_[a[contended & new_h], np.flatnonzero(kind == DIRECT)]
        at = np.r_[cover, compare]
        flag = np.r_[np.ones(len(cover), bool), np.zeros(len(compare), bool)]
        yield pa.RecordBatch.from_arrays([pa.array(flag), *(pa.array(col[c][at]) for c in ("m", "key", "s", "n"))], schema=SECOND)


BYTES = pa.schema([("m", pa.int64()), ("key", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("data", pa.binary()), ("done", pa.bool_())])


def _window_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the window at each position that has one."""
    lv, n = levels(data), len(data) - WIDTH + 1
    return mix(mix(lv[128][:n], lv[64][128 : 128 + n]), lv[8][192 : 192 + n])


def _cut_out(batches):
    """The bytes of each block to compare; blocks of hot anchors window by window, equal ones of a batch counted here."""
    for batch in batches:
        texts, keys, lists = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("key").to_pylist(), batch.column("at").to_pylist()
        rows, hot = [], []
        for t, at in enumerate(lists):
            for x in at:
                s, n = x["s"], x["n"]
                if x["hot"]:
                    m = _window_hashes(np.frombuffer(texts[t], np.uint8, n + WIDTH, s))
                    hot.append((m, np.full(n + 1, t), np.arange(s, s + n + 1)))
                else:
                    rows.append((x["m"], keys[t], s, n, texts[t][s : s + n + WIDTH], False))
        if hot:
            m, own, start = (np.concatenate(c) for c in zip(*hot, strict=True))
            _, first, which, count = np.unique(m, return_index=True, return_inverse=True, return_counts=True)
            again = np.flatnonzero(count[which] > 1).tolist()
            m = m.view(np.int64).tolist()
            rows += [(m[i], keys[own[i]], int(start[i]), 0, b"", True) for i in again]
            rows += [(m[i], keys[own[i]], int(start[i]), 0, texts[own[i]][start[i] : start[i] + WIDTH], False) for i in first.tolist()]
        for i in range(0, len(rows), 20_000):
            part = list(zip(*rows[i : i + 20_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, BYTES, strict=True)], schema=BYTES)


def repeated_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the windows at `starts` have an equal one in their group: radix passes, most significant digit first."""
    lv = levels(data, 32)
    digit = lambda at: mix(lv[32][at], lv[8][at + 32])
    left, group = np.arange(len(starts)), group.astype(np.uint64)
    for depth in range(0, WIDTH, DIGIT):
        _, group, n = np.unique(mix(mix(group + K, K), digit(starts[left] + depth)), return_inverse=True, return_counts=True)
        keep = n[group] > 1
        left, group = left[keep], group[keep].astype(np.uint64)
    return left


FOUND = pa.schema([("key", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])


def _radix(batches):
    for t in whole_groups(batches, "m"):
        done = t.column("done").to_numpy()
        if done.any():
            yield t.filter(pa.array(done)).select(FOUND.names).cast(FOUND).to_batches()[0]
        t = t.filter(pa.array(~done)).combine_chunks()
        if t.num_rows < 2:
            continue
        key, s, n, m = (t.column(c).to_numpy() for c in ("key", "s", "n", "m"))
        data = np.frombuffer(b"".join(t.column("data").to_pylist()), np.uint8)
        long = n.astype(np.int64) + WIDTH
        owner = np.repeat(np.arange(len(n)), n + 1)
        starts = np.arange(len(owner)) + (owner * (WIDTH - 1))
        assert len(data) == long.sum()
        hit = repeated_windows(data, starts, np.unique(m, return_inverse=True)[1][owner])
        own = owner[hit]
        if not len(own):
            continue
        place = starts[hit] - (np.cumsum(long) - long)[own]
        first = np.r_[True, own[1:] != own[:-1]]
        last = np.r_[own[1:] != own[:-1], True]
        own, low, high = own[first], place[first], place[last]
        yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array((s[own] + low).astype(np.int32)), pa.array((high - low).astype(np.int32))], schema=FOUND)


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remove(with_kept: bool):
    def run(batches):
        for batch in batches:
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for text, at in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("at").to_pylist(), strict=True):
                k, a, b = merge(np.zeros(len(at or ()), np.int64), np.array([x["s"] for x in at or ()], np.int64), np.array([x["s"] + x["n"] + WIDTH for x in at or ()], np.int64))
                rest, last = [], 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    rest.append(text[last:x])
                    last = y
                rest = b"".join([*rest, text[last:]]) if rest else text
                sizes.append(len(text))
                removed.append(len(text) - len(rest))
                spans.append(len(k))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_kept else None)
            out = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, schema=OUT) if with_kept else pa.RecordBatch.from_arrays(out[:-1], schema=pa.schema(list(OUT)[:-1]))

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_blocks: int = 8192, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; with_kept: the remaining bytes too."""
    scratch = Scratch(docs.sparkSession, "repeats")
    whole = text_of(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id).cast("long"), whole).alias("key"), whole.alias("text"))
    # rows that repeat an id and a text are covered as a whole; one of them stands for all towards other texts
    copies = rows.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.octet_length("text")).alias("size")).filter("rows > 1")
    copies = scratch.save(copies.select("key", F.lit(0).alias("s"), (F.col("size") - WIDTH).alias("n")), "copies")
    plain = rows.select("key", "text")
    once = plain.join(copies, "key", "left_anti").unionByName(plain.join(copies, "key", "left_semi").dropDuplicates(["key"]))
    asked = once.mapInArrow(_map_blocks, FIRST_DDL)
    second = scratch.save(asked.repartition("route").sortWithinPartitions("m").mapInArrow(_decide, "covered boolean, m long, key long, s int, n int"), "settled")
    compare = second.filter("not covered")
    hot = compare.groupBy("m").agg(F.count("*").alias("blocks")).filter(F.col("blocks") > hot_blocks).select("m", F.lit(True).alias("is_hot"))
    # an anchor's blocks are dealt to several tasks to learn whether it is hot
    salted = compare.withColumn("salt", F.pmod(F.xxhash64("key", "s"), F.lit(SALTS)).cast("int"))
    hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lists = salted.join(hot, ["m", "salt"], "left").groupBy("key").agg(F.collect_list(F.struct("m", "s", "n", F.coalesce("is_hot", F.lit(False)).alias("hot"))).alias("at"))
    parts = once.join(lists, "key").mapInArrow(_cut_out, "m long, key long, s int, n int, data binary, done boolean")
    third = scratch.save(parts.repartition("m").sortWithinPartitions("m").mapInArrow(_radix, "key long, s int, n int"), "found")
    found = second.filter("covered").select("key", "s", "n").unionByName(third).join(copies, "key", "left_anti")
    covered = found.unionByName(copies.filter("n >= 0")).groupBy("key").agg(F.collect_list(F.struct("s", "n")).alias("at"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")
    return rows.join(covered, "key", "left").select("doc_id", "text", "at").mapInArrow(_remove(with_kept), ddl)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
