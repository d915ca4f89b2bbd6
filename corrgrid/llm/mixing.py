"""Mixing sources to target weights by entropy balancing (native).

Every document gets a rate in (0, cap). Of all rates that meet the token targets of the sources,
the balancing picks the ones of greatest entropy: rate = cap / (1 + exp(-lambda * x)) with x the
document's size over its source's mean size. Safeguarded Newton steps solve the convex dual for
one multiplier per source; each step is one distributed aggregation over the histogram of
(source, size), which holds every document. Rates become whole copies by systematic rounding over
the sizes in descending order, and a few documents of each source then gain or lose one copy so
that the source meets its target as closely as its sizes allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrgrid.llm.common import BROADCAST_IDS, broadcast_if_small, discard, fresh, staged, text_or_empty, word_count

#: Sources up to this many are broadcast to the histogram (a few dozen bytes each).
BROADCAST_SOURCES = 50_000
#: Buckets that spread one (source, size) group when its documents are numbered.
BUCKETS = 64


def _targets(hist: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """Per source: source_size, n_docs, target. One row per source, so the ordered windows are small."""
    src = hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    src = src.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(cap)).withColumn("ratio", F.col("limit") / F.col("weight"))
    every, before = Window.partitionBy(), Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    src = src.withColumn("level", left / open_weight)
    # The first source, by limit over weight, whose share stays within its limit sets the level for all after it.
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))
    src = src.withColumn("chosen", F.min(fits).over(every)["level"])
    target = F.least(F.col("limit"), F.coalesce(F.col("chosen") * F.col("weight"), F.col("limit")))
    return src.select("skey", "source_size", "n_docs", target.alias("target"))


def _rate(cap: int) -> Column:
    tilt = F.lit(float(cap)) / (1.0 + F.exp(-F.col("lam") * F.col("size") / F.col("mean")))
    return F.when(F.col("full"), F.lit(float(cap))).when(F.col("size") == 0, F.lit(1.0)).otherwise(tilt)


def _solve(hist: DataFrame, src: DataFrame, cap: int, tolerance: float, steps: int) -> DataFrame:
    """Newton on the dual, one multiplier per source, bracketed by the signs seen so far."""
    ratio = F.col("target") / (F.col("source_size") * float(cap))
    full = F.col("target") >= F.col("source_size") * float(cap)
    start = F.when(full | (F.col("source_size") == 0), 0.0).otherwise(F.log(ratio / (1 - ratio)))
    state = src.select("*", full.alias("full"), F.when(F.col("source_size") == 0, 1.0).otherwise(F.col("source_size") / F.col("n_docs")).alias("mean"), start.alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), full.alias("done"))
    state = staged(state)
    small = state.count() <= BROADCAST_SOURCES
    for _ in range(steps):
        joined = hist.join(F.broadcast(state) if small else state, "skey")
        rate = _rate(cap)
        slope = F.when(F.col("full"), 0.0).otherwise(rate * (1 - rate / float(cap)) * F.col("size") / F.col("mean"))
        keep = [F.first(c).alias(c) for c in state.columns if c != "skey"]
        sums = joined.groupBy("skey").agg(*keep, F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.col("n") * F.col("size") * slope).alias("slope"))
        gap = F.col("got") - F.col("target")
        hi, lo = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")), F.when(gap <= 0, F.col("lam")).otherwise(F.col("lo"))
        step = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        inside = step.isNotNull() & (F.col("lo2").isNull() | (step > F.col("lo2"))) & (F.col("hi2").isNull() | (step < F.col("hi2")))
        wide = F.when(gap > 0, F.col("lam") - 1 - F.abs("lam")).otherwise(F.col("lam") + 1 + F.abs("lam"))
        safe = F.coalesce((F.col("lo2") + F.col("hi2")) / 2, wide)
        done = F.col("full") | (F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0)))
        nxt = sums.withColumn("hi2", hi).withColumn("lo2", lo).select("skey", "source_size", "n_docs", "target", "full", "mean", F.when(done, F.col("lam")).when(inside, step).otherwise(safe).alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), done.alias("done"))
        last, state = state, staged(nxt.coalesce(1) if small else nxt)
        discard(last)
        if state.where("not done").isEmpty():
            break
    else:
        if not state.where("not done").isEmpty():
            raise RuntimeError(f"the balancing did not meet its targets within {tolerance} in {steps} steps")
    # Sums of doubles differ in their last digits from run to run; what follows must not.
    return state.withColumn("lam", F.round("lam", 7))


def entropy_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tolerance: float = 1e-4, steps: int = 60) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, then source, rate, copies.

    Sizes are words. Sources in code point order (null last, as a source of its own) weigh
    `weights`, repeating, and share `share` times all words; a target stops at `cap` times its
    source's size and the excess is shared again. taken is copies * size, copies 0 to cap. Null and
    empty texts have size 0 and take 0 words in one copy; a source without words has target 0.
    Repeated rows are separate rows. Empty tables give no rows; further columns are ignored. The result
    depends only on the rows, but repeated rows may swap places.
    """
    skey = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    sized = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), skey.alias("skey"), word_count(text_or_empty(text_col)).alias("size"), F.monotonically_increasing_id().alias("rid")))
    hist = staged(sized.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")))
    state = _solve(hist, _targets(hist, weights, share, cap), cap, tolerance, steps)
    small = state.count() <= BROADCAST_SOURCES
    dual = F.broadcast(state) if small else state

    groups = hist.join(dual, "skey").select("skey", "size", "n", "source_size", "target", _rate(cap).alias("rate"))
    above = Window.partitionBy("skey").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.round(F.sum(F.col("n") * F.col("rate")).over(above), 6), F.lit(0.0)))
    groups = groups.withColumn("m", F.when(F.col("size") == 0, F.col("n")).otherwise(F.floor(F.col("before") + F.col("n") * F.col("rate") + 0.5) - F.floor(F.col("before") + 0.5)))
    groups = staged(groups.withColumn("m", F.least(F.col("m"), F.col("n") * cap)))
    rest = groups.groupBy("skey").agg((F.round(F.first("target")) - F.sum(F.col("m") * F.col("size"))).alias("rest"))

    # Number the documents of each (source, size), bucket by bucket, so that no group meets in one task.
    order = F.xxhash64("doc_id")
    placed = sized.withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)))
    buckets = placed.groupBy("skey", "size", "bucket").agg(F.count(F.lit(1)).alias("k"))
    offset = F.sum("k").over(Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.select("skey", "size", "bucket", F.coalesce(offset, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy("order", "doc_id", "rid"))
    placed = placed.withColumn("within", within).join(buckets, ["skey", "size", "bucket"])
    placed = placed.join(groups.select("skey", "size", "n", "m", "rate"), ["skey", "size"])
    number = F.col("offset") + F.col("within")
    copies = F.floor(F.col("m") / F.col("n")) + F.when(number <= F.col("m") % F.col("n"), 1).otherwise(0)
    placed = staged(placed.select("doc_id", "source", "skey", "size", "rid", "order", "rate", copies.alias("copies")))

    # At most four documents of each source and power of two may gain or lose a copy.
    one = F.struct("size", "order", "doc_id", "rid")
    grown, cut = F.when(F.col("copies") < cap, one), F.when(F.col("copies") > 0, one)
    octaves = placed.where("size > 0").groupBy("skey", F.floor(F.log2("size")).alias("octave")).agg(F.min(grown).alias("a"), F.max(grown).alias("b"), F.min(cut).alias("c"), F.max(cut).alias("d"))
    tag = lambda c, sign: F.struct(F.col(f"{c}.size").alias("size"), F.col(f"{c}.order").alias("order"), F.col(f"{c}.rid").alias("rid"), F.lit(sign).alias("sign"))
    options = octaves.select("skey", F.filter(F.array_distinct(F.array(tag("a", 1), tag("b", 1), tag("c", -1), tag("d", -1))), lambda x: x["rid"].isNotNull()).alias("some"))
    options = options.groupBy("skey").agg(F.sort_array(F.flatten(F.collect_list("some")), asc=False).alias("some")).join(rest, "skey")
    none = F.array().cast("array<struct<rid:bigint,sign:int>>")
    fold = F.aggregate(
        "some",
        F.struct(F.col("rest").cast("double").alias("rest"), none.alias("picks")),
        lambda acc, x: F.when(
            acc["rest"] * x["sign"] * 2 > x["size"],
            F.struct((acc["rest"] - x["sign"] * x["size"]).cast("double").alias("rest"), F.concat(acc["picks"], F.array(F.struct(x["rid"].alias("rid"), x["sign"].alias("sign")))).alias("picks")),
        ).otherwise(F.struct(acc["rest"].alias("rest"), acc["picks"].alias("picks"))),
    )
    picks = options.select(F.explode(fold["picks"]).alias("p")).groupBy(F.col("p.rid").alias("rid")).agg(F.sum("p.sign").alias("change"))
    final = placed.join(picks, "rid", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    final = final.join(dual.select("skey", "source_size", "target"), "skey")
    return final.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", F.col("copies").cast("int").alias("copies"))


def repeat_copies(docs: DataFrame, *, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns.

    Ids name rows here: of rows that share an id each is taken as often as the one taken most; rows
    whose id is null stay once. Null and empty texts stay once; empty tables give none; further columns may have any name.
    """
    key, copies, n = fresh(docs, "mix_id", "mix_copies", "mix_n")
    found = entropy_mix(docs, id_col=id_col, **options).where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(copies))
    found = staged(found.where(F.col(copies) != 1))
    joined = docs.join(broadcast_if_small(found, found.count(), BROADCAST_IDS), F.col(id_col) == F.col(key), "left")
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.coalesce(copies, F.lit(1)))).alias(n)).drop(n)
