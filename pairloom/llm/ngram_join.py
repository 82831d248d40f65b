"""Joins texts whose word shingles have a Jaccard similarity of a threshold or more, by prefixes under several orders.

A text's set is the XXH64 values of its distinct shingles; texts with equal sets are one node. Under any global order of
the shingles, two sets whose similarity reaches the threshold share one among the first n - ceil(least * n) + 1 of each.
A pair is a candidate only if that holds under each of several orders, so the filters are intersected:

1. Under the first order the prefixes of all sets are dealt out by shingle. A shingle that no other set of a fitting size
   has in its prefix makes no candidates, and its rows end there.
2. Pairs that still stand must pass an upper bound of their shared shingles before any text is moved: the sum over the
   cells of a histogram of the smaller of both counts.
3. Where the two texts meet, their prefixes under all other orders must meet as well, and then the sets are compared.

All orders put shingles last that many documents have, as counted in a bounded sample; each then goes by a hash of its
own. The sample shapes the orders only: prefixes under any order lose no pair.

Large groups of similar texts never become all their pairs. First a set is compared with two others of its shingles'
lists, the ones it shares most prefix shingles with among the least and greatest of each list; that joins most groups by
as many pairs as they have sets. Then only lists whose members are not all joined are looked at, and in them only pairs
from different components; lists of more than `block` sets are dealt out as pairs of blocks. So every link is checked
or already implied, and no group of copies is collected. Lists of very common shingles are dealt to several tasks.

A null text counts as empty; an empty text or one of white space has no set and is linked with nothing. A text with
fewer words than a shingle is one shingle. Very long texts are sets like others. Equal texts and repeated rows are one
node. A null id never names a component, unless nothing else is in it: then the component is null. An empty table gives
an empty result. Columns beside id and text are ignored. Shingles and sets are told apart by 64-bit hashes: two
different ones among a billion agree with a probability of 3 in 100.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, slices, text_of
from .repeats import whole_groups
from .simhash import SEED, connect, fingerprint_of, roots_of, shingle_hashes

#: Documents of the sample that shapes the orders, the fewest of them a common shingle is in, and common shingles kept.
SAMPLE, COMMON, MOST_COMMON = 16384, 4, 1 << 17
#: Bytes of text that are taken at once.
PIECE = 1 << 22
#: Tasks that the list of a common shingle is dealt to.
SALTS = 16
_R = np.random.default_rng(SEED)
MASKS = _R.integers(0, 1 << 63, 16, np.uint64)
TIMES = _R.integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted; none for a text without words."""
    return np.unique(shingle_hashes(text, width))


class Orders:
    """Global orders of shingles: common ones last, then by a hash of the order's own."""

    def __init__(self, common: np.ndarray, counts: np.ndarray):
        at = np.argsort(common)
        self.common, self.rank = common[at], np.minimum(15, np.log2(np.maximum(counts[at], 1)).astype(np.uint64))

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.zeros(len(tokens), np.uint64)
        at = np.minimum(np.searchsorted(self.common, tokens), len(self.common) - 1)
        return np.where(self.common[at] == tokens, self.rank[at], np.uint64(0))

    def prefix(self, tokens: np.ndarray, ranks: np.ndarray, order: int, least: int) -> np.ndarray:
        """The places of the first shingles of a set under an order, in that order."""
        place = (ranks << np.uint64(60)) | (((tokens ^ MASKS[order]) * TIMES[order]) >> np.uint64(4))
        n = len(tokens)
        return np.argsort(place, kind="stable")[: n + (-least * n) // 100 + 1]


def histogram(tokens: np.ndarray) -> bytes:
    """Counts of a set's shingles by their low bits, in about half as many cells; 255 stands for that or more."""
    cells = 1 << min(12, max(4, (len(tokens) // 2).bit_length()))
    return np.minimum(np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def most_shared(a: bytes, b: bytes, n: int) -> int:
    """An upper bound of what two sets share, by their histograms; n is the smaller size."""
    x, y = (np.frombuffer(h, np.uint8) for h in (a, b))
    if x.max() == 255 or y.max() == 255:
        return n
    x, y = x.astype(np.int64), y.astype(np.int64)
    cells = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, cells).sum(0), y.reshape(-1, cells).sum(0)).sum())


def enough(n: int | np.ndarray, m: int | np.ndarray, least: int) -> int | np.ndarray:
    """The fewest shared shingles with which sets of n and m are similar."""
    return -(-least * (n + m) // (100 + least))


MARKS = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("common", pa.list_(pa.bool_())), ("cells", pa.binary()), ("fp", pa.int64())])
MARKS_DDL = "doc_id long, own long, key long, n long, tokens array<long>, common array<boolean>, cells binary, fp long"


def _key(tokens: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(tokens.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def common_shingles(docs: DataFrame, width: int) -> Orders:
    """The orders, by the shingles that come up most in a sample of documents."""
    one = pa.schema([("token", pa.int64())])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches if batch.num_rows for part in slices(batch, "text", PIECE)):
            found = [shingles(t, width) for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], schema=one)

    share = 1 << 20
    limit = min(share, SAMPLE * share // max(1, docs.count()) + 1)
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) < limit).select(text_of().alias("text"))
    counts = some.mapInArrow(tokens, "token long").groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    rows = counts.orderBy(F.desc("n"), "token").limit(MOST_COMMON).toArrow()
    return Orders(rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy())


def marked(docs: DataFrame, orders, least: int, width: int) -> DataFrame:
    """doc_id, own, key and n of every document; tokens (the first order's prefix), common, cells and fp once a task and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        order = orders.value

        def mark(text: bytes) -> tuple:
            hashes = shingle_hashes(text, width)
            if not len(hashes):
                return None, 0, None, None, None, None
            tokens = np.unique(hashes)
            key = _key(tokens)
            if key in seen:
                return key, len(tokens), None, None, None, None
            seen.add(key)
            ranks = order.ranks(tokens)
            first = order.prefix(tokens, ranks, 0, least)
            return key, len(tokens), tokens[first].view(np.int64), ranks[first] > 0, histogram(tokens), int(np.uint64(fingerprint_of(hashes)).view(np.int64))

        for part in (part for batch in batches if batch.num_rows for part in slices(batch, "text", PIECE)):
            found = zip(*map(mark, part.column("text").cast(pa.binary()).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("own"), *(pa.array(c, f.type) for c, f in zip(found, list(MARKS)[2:], strict=True))], schema=MARKS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("own"), text_of().alias("text"))
    return rows.mapInArrow(run, MARKS_DDL)


# --- candidates -----------------------------------------------------------------------------------------------------


LISTED = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
LISTED_DDL = "token long, key long, n int, pos int"


def _listed(least: int):
    """Of rows sorted by token, n, pos and key: those with a neighbour of fitting size in their token's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held[0], table])
            token, key, n, pos, common = (table.column(c).to_numpy() for c in ("token", "key", "n", "pos", "common"))
            # the first row, if held, has been compared with the one before it
            again = np.r_[False, (token[1:] == token[:-1]) & (key[1:] == key[:-1])]
            at = np.flatnonzero(~again)
            token, key, n, pos, common = token[at], key[at], n[at], pos[at], common[at]
            near = (token[1:] == token[:-1]) & (100 * n[:-1].astype(np.int64) >= least * n[1:].astype(np.int64))
            stays = np.r_[held is not None and held[1], near] | np.r_[near, False] | common
            # the last row waits for the next batch
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][stays[:-1]], f.type) for c, f in zip((token, key, n, pos), LISTED, strict=True)], schema=LISTED)
            held = table.slice(int(at[-1]), 1), bool(stays[-1])
        if held is not None and held[1]:
            yield held[0].select(LISTED.names).cast(LISTED).combine_chunks().to_batches()[0]

    return run


def prefix_lists(marks: DataFrame, least: int) -> DataFrame:
    """token, key, n and pos of the prefixes under the first order, without tokens that make no pair."""
    rows = marks.filter("tokens is not null").select("key", F.col("n").cast("int").alias("n"), F.posexplode(F.arrays_zip("tokens", "common")).alias("pos", "x"))
    rows = rows.select(F.col("x.tokens").alias("token"), "key", "n", "pos", F.col("x.common").alias("common"))
    salt = F.when(F.col("common"), F.pmod(F.col("key"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    dealt = rows.withColumn("salt", salt).repartition("token", "salt").drop("salt").sortWithinPartitions("token", "n", "pos", "key")
    return dealt.mapInArrow(_listed(least), LISTED_DDL)


def few_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): each set with two others of its lists, those it shares most prefix shingles with.

    A list offers its least set and its most central one: the set of whose prefix the largest part is in lists. What a
    copy has changed is in no list, so the text that many were made from is central to all of them.
    """
    part = F.max(F.struct("n", "key"))
    central = lists.groupBy("key").agg(F.count("*").alias("m"), F.first("n").alias("size")).select("key", F.floor(1000 * F.col("m") / F.col("size")).cast("int").alias("n"))
    ranked = lists.select("token", "key").join(central, "key")
    ends = ranked.groupBy("token").agg(F.min("key").alias("low"), part.alias("high")).select("token", "low", F.col("high.key").alias("high"))
    met = lists.select("token", "key").join(ends, "token").select("key", F.explode(F.array_distinct(F.array("low", "high"))).alias("other")).filter("key <> other")
    shared = met.groupBy("key", "other").agg(F.count("*").alias("n"))
    best = shared.withColumn("rank", F.expr("row_number() over (partition by key order by n desc, other)")).filter("rank <= 2")
    return best.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): stars of the components that the SimHash operator makes of the sets' fingerprints. sets have key and fp."""
    scratch = Scratch(sets.sparkSession, "simhash-stage")
    roots = roots_of(scratch.save(sets.select("fp").distinct(), "fps"), scratch)
    named = scratch.save(sets.select("key", "fp").join(roots, "fp").select("key", "root"), "named")
    hubs = named.groupBy("root").agg(F.min("key").alias("a"))
    return named.join(hubs, "root").filter("a < key").select("a", F.col("key").alias("b"))


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _apart(least: int):
    """Pairs of sets from different components whose sizes, places and histograms fit, of rows sorted by gid and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "gid"):
            gid, key, root, n, pos, part, i, j = (t.column(c).to_numpy() for c in ("gid", "key", "root", "n", "pos", "part", "i", "j"))
            n, pos, cells = n.astype(np.int64), pos.astype(np.int64), t.column("cells").to_pylist()
            # x is the smaller set of a pair, and its place has to leave it enough
            x, step = np.flatnonzero(n - pos >= enough(n, n, least)), 1
            while len(x):
                y = x + step
                x, y = x[y < len(n)], y[y < len(n)]
                go = (gid[x] == gid[y]) & (100 * n[x] >= least * n[y])
                x, y = x[go], y[go]
                fits = (root[x] != root[y]) & ((i[x] == j[x]) | (part[x] != part[y]))
                need = enough(n[x], n[y], least)
                fits &= np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need
                at = [k for k in np.flatnonzero(fits).tolist() if most_shared(cells[x[k]], cells[y[k]], int(n[x[k]])) >= need[k]]
                a, b = key[x[at]], key[y[at]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=PAIRS)
                step += 1

    return run


def pairs_apart(lists: DataFrame, roots: DataFrame, sets: DataFrame, least: int, block: int) -> DataFrame:
    """(a, b): pairs from different components that share a prefix shingle and may share enough."""
    own = lists.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = own.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).filter("low < high")
    parts = F.ceil(F.col("m") / block).cast("int")
    dealt = own.join(mixed.select("token", parts.alias("parts")), "token").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).withColumn("gid", F.xxhash64("token", "i", "j"))
    dealt = dealt.select("gid", "key", "root", "n", "pos", "part", "i", "j").join(sets.select("key", "cells"), "key")
    return dealt.repartition("gid").sortWithinPartitions("gid", "n", "key").mapInArrow(_apart(least), "a long, b long").distinct()


def bounded(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose sizes and histograms allow enough shared shingles. sets have key, n and cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            need, low = enough(n, m, least).tolist(), np.minimum(n, m).tolist()
            x, y = batch.column("cells_a").to_pylist(), batch.column("cells_b").to_pylist()
            stays = [low[k] >= need[k] and most_shared(x[k], y[k], low[k]) >= need[k] for k in range(len(need))]
            yield batch.select(["a", "b"]).filter(pa.array(stays, pa.bool_()))

    side = lambda s: sets.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("cells").alias(f"cells_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "cells_a", "cells_b").mapInArrow(run, "a long, b long")


def _checked(orders, least: int, width: int, n_orders: int):
    """The links of rows sorted by gid, a pair's hub (null other) before the sets that are compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = orders.value

        def set_of(text: bytes):
            tokens = shingles(text, width)
            ranks = order.ranks(tokens)
            return tokens, [np.sort(tokens[order.prefix(tokens, ranks, k, least)]) for k in range(n_orders)]

        def similar(x, y) -> bool:
            if not all(len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x[1], y[1], strict=True)):
                return False
            shared = len(np.intersect1d(x[0], y[0], assume_unique=True))
            return 100 * shared >= least * (len(x[0]) + len(y[0]) - shared)

        for t in whole_groups(batches, "gid"):
            found, hubs, group = [], {}, None
            texts = t.column("text").cast(pa.binary())
            for k, (gid, key, other) in enumerate(zip(*(t.column(c).to_pylist() for c in ("gid", "key", "other")), strict=True)):
                if gid != group:
                    hubs, group = {}, gid
                own = set_of(texts[k].as_py())
                if other is None:
                    hubs[key] = own
                elif similar(hubs[other], own):
                    found.append((key, other))
            a, b = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=PAIRS)

    return run


def checked(pairs: DataFrame, texts: DataFrame, orders, least: int, width: int, n_orders: int, block: int = 256) -> DataFrame:
    """The pairs (a, b) that share prefix shingles under all orders and are similar. texts have key and text."""
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = pairs.join(hubs, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    dealt = dealt.select("a", "b", F.xxhash64("b", "part").alias("gid"))
    rows = dealt.select("gid", F.col("a").alias("key"), F.col("b").alias("other"))
    rows = rows.unionByName(dealt.select("gid", F.col("b").alias("key"), F.lit(None).cast("long").alias("other")).distinct())
    placed = rows.join(texts, "key").select("gid", "key", "other", "text")
    return placed.repartition("gid").sortWithinPartitions("gid", F.asc_nulls_first("other")).mapInArrow(_checked(orders, least, width, n_orders), "a long, b long")


def similar_texts(docs: DataFrame, least: int = 80, width: int = 5, n_orders: int = 3, block: int = 2048, by_fingerprints: bool = False) -> DataFrame:
    """doc_id, own (hash of the text), key (of the set, null without one), root (a key for each component), n_shingles and
    component_id of every document.

    Two sets link where the shared shingles are `least` hundredths or more of all of theirs. by_fingerprints: sets in
    one component of the SimHash operator are compared first, and only what they leave apart goes on.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select("doc_id", "text")
    orders = spark.sparkContext.broadcast(common_shingles(docs, width))
    marks = scratch.save(marked(docs, orders, least, width), "marks")
    own = scratch.save(marks.select("doc_id", "own", "key", "n"), "own")
    sets = scratch.save(marks.filter("cells is not null").select("key", "n", "cells", "fp").dropDuplicates(["key"]), "sets")
    nodes = scratch.save(own.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("x")), "nodes")
    lists = scratch.save(prefix_lists(marks, least), "lists")
    scratch.drop("marks")

    listed = lists.select("key").distinct().join(nodes, "key").select("key", F.coalesce("x.doc_id", F.lit(0)).alias("id"), F.col("x.none").alias("none"), F.col("x.own").alias("own"))
    place = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64(text_of()).alias("own"), text_of().alias("text"))
    texts = scratch.save(place.join(listed, ["id", "none", "own"]).select("key", "text").dropDuplicates(["key"]), "texts")

    few = few_pairs(lists)
    if by_fingerprints:
        # a set that is in no list has no partner
        stars = fingerprint_pairs(sets.join(lists.select("key").distinct(), "key", "left_semi"))
        few = few.unionByName(stars).distinct()
    few = scratch.save(few, "few")
    links = scratch.save(checked(bounded(few, sets, least), texts, orders, least, width, n_orders), "links")
    inner = Scratch(spark, "ngram-join-few")
    roots = connect(links, inner)
    more = scratch.save(pairs_apart(lists, roots, sets, least, block).join(few, ["a", "b"], "left_anti"), "more")
    further = scratch.save(checked(more, texts, orders, least, width, n_orders), "further")
    roots = connect(links.unionByName(further), Scratch(spark, "ngram-join-all"))

    named = scratch.save(nodes.join(roots, nodes["key"] == roots["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root")), "named")
    components = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(components, "root").select(F.col("key").alias("set_key"), "root", "component_id")
    found = own.join(classes, own["key"] == classes["set_key"], "left")
    return found.select("doc_id", "own", "key", "root", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
