"""Exact percentiles by bracketed selection.

Each wanted rank of a key keeps an interval of values that holds it, with the number of values below.
A round counts the interval's values in equal bins, with each bin's least and greatest value, and
narrows the interval to the bin of the rank; it is found once both are equal. Counts are added up in
the tasks that read the values, so a key of any size is never gathered or held as distinct values:
what is shuffled is at most BINS rows per rank and task, whatever the distribution. Keys and values are
written once, so a round costs a read of them whatever the values were computed from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrgrid.staging import discard, staged

BINS = 1_024
#: Wanted ranks up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_RANKS = 200_000


def percentiles(df: DataFrame, keys: Sequence[str], value: Column | str, shares: Sequence[float], *, bins: int = BINS) -> DataFrame:
    """keys, p (array of doubles, one per share): values at share * (n - 1) in ascending order, interpolated between neighbours.

    NULL and NaN are left out; keys without a value have no row. A NULL key is a key. Infinities are
    ordinary greatest and least values.
    """
    v = F.col(value) if isinstance(value, str) else value
    names = [f"_k{i}" for i in range(len(keys))]
    # Each round reads keys and values alone. The filter comes after: pushed below, it would repeat the value's expression.
    held = staged(df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], v.cast("double").alias("_v")))
    rows = held.where("_v is not null and not isnan(_v)")
    bounds = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    place = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    wanted = F.array(*[F.struct(F.lit(2 * i + up).alias("slot"), (F.ceil(p) if up else F.floor(p)).cast("long").alias("rank")) for i, p in enumerate(place) for up in (0, 1)])
    state = staged(bounds.select(*names, "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.inline(wanted)))
    same = lambda a, b: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    while True:
        # Slots of one key with one interval narrow together.
        open_ = state.where("lo < hi")
        n_open = open_.count()
        if not n_open:
            break
        spans = open_.groupBy(*names, "lo", "hi").agg(F.count(F.lit(1)).alias("slots")).drop("slots")
        spans = F.broadcast(spans) if n_open <= BROADCAST_RANKS else spans
        condition = same("r", "s")
        met = rows.alias("r").join(spans.alias("s"), condition[0] if len(condition) == 1 else _all(condition)) if names else rows.alias("r").join(spans.alias("s"))
        met = met.where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).select(*[F.col(f"r.{n}").alias(n) for n in names], "lo", "hi", "_v")
        # Halves keep the span of any two doubles finite; infinite ends stand in bins of their own.
        low, high = (F.greatest(F.least(F.col(c), F.lit(1.7e308)), F.lit(-1.7e308)) / 2 for c in ("lo", "hi"))
        at = F.least(F.floor((F.greatest(F.least(F.col("_v"), F.lit(1.7e308)), F.lit(-1.7e308)) / 2 - low) / (high - low) * bins), F.lit(bins - 1))
        at = F.when(F.col("_v") == F.col("lo"), -1).when(F.col("_v") == F.col("hi"), bins).otherwise(at)
        counts = met.groupBy(*names, "lo", "hi", at.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("b_lo"), F.max("_v").alias("b_hi"))
        before = Window.partitionBy(*names, "lo", "hi").orderBy("bin")
        counts = counts.withColumn("upto", F.sum("c").over(before))
        rank_in = F.col("rank") - F.col("below")
        joined = open_.alias("o").join(counts.alias("c"), _all([*same("o", "c"), F.col("o.lo") == F.col("c.lo"), F.col("o.hi") == F.col("c.hi")]))
        moved = joined.where((rank_in < F.col("upto")) & (rank_in >= F.col("upto") - F.col("c.c"))).select(*[F.col(f"o.{n}").alias(n) for n in names], "o.n", F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), (F.col("below") + F.col("upto") - F.col("c.c")).alias("below"), "slot", "rank")
        last, state = state, staged(state.where("lo >= hi").unionByName(moved))
        discard(last)
    discard(held)
    found = state.groupBy(*names, "n").agg(F.map_from_entries(F.collect_list(F.struct("slot", "lo"))).alias("at"))  # two slots per share
    part = [p - F.floor(p) for p in place]
    low, high = (lambda i: F.element_at("at", F.lit(2 * i))), (lambda i: F.element_at("at", F.lit(2 * i + 1)))
    value_at = [F.when(low(i) == high(i), low(i)).otherwise(low(i) + (high(i) - low(i)) * part[i]) for i in range(len(shares))]
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], F.array(*value_at).alias("p"))


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
