"""Mixing sources to target weights by entropy balancing. Built-in functions only.

The rates r_d of documents minimise the entropy  sum r_d log r_d - r_d  under one token constraint a source,
sum size_d r_d = target, and r_d at most `most_copies`. The dual is convex and separable by source, and its solution is
an exponential tilt by a document's size:  r_d = min(most_copies, exp(lambda size_d)).  With F(lambda) = sum size_d r_d
and G(lambda) = sum of size_d^2 r_d over documents below the limit, Newton's step for  log F = log target  is

    lambda += (log target - log F) F / G,

a distributed aggregation over (source, size) cells with their counts, so documents are pre-aggregated once. A step
that leaves the interval known to hold the solution is replaced by its middle, so the steps always converge; running
out of `most_steps` raises. A source that needs less than it has is tilted towards short documents, one that needs more
towards long ones. Targets never ask for more than `most_copies` of a source, where all its rates are that limit.

Rounding: every document is taken floor(r) times. Extra copies go to the documents of a source in the order of
u / (r - floor(r)), u a hash of the document in 0..1, until the source's target is reached: a document gets one with
about the probability r - floor(r). A histogram of that order finds the cell in which the target is reached, only that
cell is sorted, and a few more rounds fill what is left with the largest document that still fits.

Nulls: a null text has size 0 and is never taken; a null source is a source of its own, the last one. Repeated rows
are documents of their own; rows equal in id, source and text are told apart by their place in the input. An empty
table gives an empty result. Columns beside id, text and source are ignored by the counts and kept by take_copies,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, fresh, text_of

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 4096


def by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on source; a null source meets a null source."""
    right = right.withColumnRenamed("source", "__source")
    return left.join(right, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def token_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3) -> DataFrame:
    """source, source_size and target of every source of sizes (source, size).

    Sources at their limit are found in the order of limit / weight: with the sources before it at their limit, a
    source is at its own if the share that is left for it exceeds it.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = total.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(most_copies)).withColumn("level", F.col("most") / F.col("weight"))
    order = Window.orderBy("level", "rank").rowsBetween(Window.unboundedPreceding, -1)
    before = ranked.withColumn("most_before", F.coalesce(F.sum("most").over(order), F.lit(0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    everywhere = Window.partitionBy(F.lit(0))
    left = before.withColumn("rate", (F.sum("source_size").over(everywhere) - F.col("most_before")) / (F.sum("weight").over(everywhere) - F.col("weight_before")))
    left = left.withColumn("full", F.col("rate") * F.col("weight") >= F.col("most"))
    rate = F.max(F.when(~F.col("full"), F.struct((-F.col("level")).alias("k"), (-F.col("rank")).alias("r"), F.col("rate").alias("rate")))).over(everywhere)["rate"]
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(rate * F.col("weight"))
    return left.select("source", "source_size", target.alias("target"))


def balance(cells: DataFrame, targets: DataFrame, scratch: Scratch, most_copies: int = 3, most_steps: int = 100, close: float = 1e-7) -> DataFrame:
    """Newton's method for the dual: targets with `lambda`; cells (source, size, n). Sources without words get 0."""
    limit = math.log(most_copies)
    # every size is 1 or more: at log(most_copies) all rates are at their limit; far enough below, all but vanish
    bounds = cells.filter("size > 0").groupBy("source").agg(F.min("size").alias("least"), (F.sum(F.col("size") * F.col("size") * F.col("n").cast("double")) / F.sum(F.col("size") * F.col("n"))).alias("mean"))
    dual = by_source(targets, bounds, "left").withColumn("high", F.lit(limit) / F.col("least")).withColumn("low", (F.log(F.greatest("target", F.lit(1e-300))) - F.log(F.greatest("source_size", F.lit(1)) + F.lit(1.0)) - 1.0) / F.col("least"))
    full = F.col("target") >= F.col("source_size") * (most_copies - close)
    dual = dual.withColumn("open", F.col("least").isNotNull() & (F.col("target") > 0) & ~full)
    # a first guess: all words in documents of the mean size
    guess = F.least(F.log(F.col("target") / F.col("source_size")) / F.col("mean"), F.col("high") / 2)
    dual = dual.withColumn("lambda", F.when(F.col("open"), guess).when(full & F.col("least").isNotNull(), F.col("high")).otherwise(F.lit(0.0)))
    dual = scratch.save(dual.select("source", "source_size", "target", "low", "high", "open", "lambda"), "dual")
    for step in range(most_steps):
        if not dual.filter("open").limit(1).count():
            return dual.drop("low", "high", "open")
        tilt = F.exp(F.col("lambda") * F.col("size"))
        words = F.col("size") * F.col("n") * F.least(tilt, F.lit(float(most_copies)))
        slope = F.when(tilt < most_copies, F.col("size") * words).otherwise(F.lit(0.0))
        sums = by_source(cells.filter("size > 0"), dual.filter("open").select("source", "lambda")).groupBy("source").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        at = by_source(dual, sums, "left")
        over = F.col("words") > F.col("target")
        at = at.withColumn("high", F.when(F.col("open") & over, F.col("lambda")).otherwise(F.col("high"))).withColumn("low", F.when(F.col("open") & ~over, F.col("lambda")).otherwise(F.col("low")))
        at = at.withColumn("next", F.col("lambda") + (F.log("target") - F.log("words")) * F.col("words") / F.col("slope"))
        inside = (F.col("slope") > 0) & (F.col("next") > F.col("low")) & (F.col("next") < F.col("high"))
        at = at.withColumn("next", F.when(inside, F.col("next")).otherwise((F.col("low") + F.col("high")) / 2))
        done = (F.abs(F.col("words") - F.col("target")) <= F.col("target") * close) | (F.col("high") - F.col("low") <= F.abs(F.col("high")) * 1e-15)
        at = at.withColumn("still", F.col("open") & ~done)
        at = at.withColumn("lambda", F.when(F.col("still"), F.col("next")).otherwise(F.col("lambda")))
        dual = scratch.save(at.select("source", "source_size", "target", "low", "high", F.col("still").alias("open"), "lambda"), f"dual{step}")
        if step > 1:
            scratch.drop(f"dual{step - 2}")
    raise RuntimeError(f"the rates have not converged after {most_steps} steps")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3, fill_rounds: int = 4) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, rate, copies and taken of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    whole_text = text_of(text)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.xxhash64(whole_text).alias("text_hash"), F.regexp_count(whole_text, F.lit(WORD)).cast("long").alias("size"))
    # the row number is written down, so it is the same for every later reader
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    cells = scratch.save(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    targets = scratch.save(token_targets(cells.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most_copies), "targets")
    dual = balance(cells, targets, scratch, most_copies)
    # tilts by cell: the whole copies of a document, and the part of one that is left
    rate = F.when(F.col("size") > 0, F.least(F.exp(F.col("lambda") * F.col("size")), F.lit(float(most_copies)))).otherwise(F.lit(0.0))
    tilted = lambda df: df.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    taken = tilted(by_source(cells, dual)).groupBy("source").agg(F.sum(F.col("whole") * F.col("size") * F.col("n")).alias("taken"))
    plan = scratch.save(by_source(dual, taken, "left").withColumn("more", F.greatest(F.lit(0.0), F.col("target") - F.coalesce("taken", F.lit(0)))).drop("taken"), "plan")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "source", "size", "text_hash"), 11) + 0.5) / float(1 << 53)
    rows = tilted(by_source(rows, plan.select("source", "lambda")))
    rows = rows.withColumn("order", F.when(F.col("part") > 1e-9, uniform / (uniform + F.col("part"))).otherwise(F.lit(1.0)))
    rows = scratch.save(rows.drop("lambda", "part"), "rated")

    cell = F.floor(F.col("order") * CELLS).cast("int")
    extra = rows.filter("size > 0 and order < 1")
    sums = extra.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("tokens"))
    before = sums.withColumn("before", F.sum("tokens").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    at = by_source(before, plan.select("source", "more")).filter("more > 0").groupBy("source").agg(F.max_by(F.struct("cell", "before"), F.when(F.col("before") <= F.col("more"), F.col("cell"))).alias("at"), F.first("more").alias("more"))
    at = scratch.save(at.select("source", F.col("at.cell").alias("at"), (F.col("more") - F.col("at.before")).alias("left")), "cell")
    # in that cell documents are taken while they fit; what is left goes to the fill
    inside = by_source(extra, at).filter(cell == F.col("at"))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("order", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0))
    inside = scratch.save(inside.withColumn("run", run).filter("run <= left").select("row", "source", "size"), "inside")
    rest = by_source(at, inside.groupBy("source").agg(F.sum("size").alias("used")), "left").select("source", "at", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"))
    picks = inside.select("row")
    late = by_source(extra, at.select("source", "at")).filter(cell >= F.col("at")).select("row", "source", "size", "order")
    for k in range(fill_rounds):
        # the last round may go over, if that comes closer
        fits = F.col("size") <= F.col("left") if k < fill_rounds - 1 else F.col("size") < 2 * F.col("left")
        near = F.struct((-F.abs(F.col("left") - F.col("size"))).alias("near"), (-F.col("order")).alias("o"), (-F.col("row")).alias("r"), F.col("row"), F.col("size"))
        free = by_source(late.join(picks, "row", "left_anti"), rest.select("source", "left")).filter(fits)
        pick = scratch.save(free.groupBy("source").agg(F.max(near).alias("best")).select("source", "best.row", "best.size"), f"pick{k}")
        picks = picks.unionByName(pick.select("row"))
        rest = scratch.save(by_source(rest, pick.select("source", "size"), "left").select("source", "at", (F.col("left") - F.coalesce("size", F.lit(0))).alias("left")), f"rest{k}")
    out = by_source(by_source(rows, plan.select("source", "source_size", "target")), at.select("source", "at"), "left").join(picks.withColumn("picked", F.lit(1)), "row", "left")
    one_more = (F.col("order") < 1) & ((cell < F.col("at")) | F.col("picked").isNotNull())
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(one_more, 1).otherwise(0)).otherwise(0).cast("long")
    out = out.withColumn("copies", copies)
    return out.select("doc_id", "source", "text_hash", "size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_copies(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source and others) with each row as often as the mix takes it.

    Rows that are equal in id, source and text are told apart by a number on both sides of the join.
    """
    own, id_, from_, number, key, copies, copy = fresh(docs, "hash", "id", "source", "number", "key", "copies", "copy")
    numbered = F.row_number().over(Window.partitionBy(id_, from_, own).orderBy(F.lit(0)))
    joined = F.xxhash64(own, id_, from_, number)
    mixed = mix_sources(docs.select("doc_id", "text", "source")).filter("copies > 0").select(F.col("text_hash").alias(own), F.col("doc_id").alias(id_), F.col("source").alias(from_), F.col("copies").cast("int").alias(copies))
    mixed = mixed.withColumn(number, numbered).select(joined.alias(key), copies)
    named = [F.xxhash64(text_of()).alias(own), F.col("doc_id").alias(id_), F.col("source").cast("string").alias(from_)]
    rows = docs.select("*", *named).withColumn(number, numbered).withColumn(key, joined)
    taken = rows.join(mixed, key).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy))
    return taken.drop(copy)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
