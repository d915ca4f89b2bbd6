"""Regular expression matches with code point offsets, in SQL expressions only (native)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string,part:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def matches(text: Column, pattern: str, *, guard: Column | None = None, part: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs start, end, text, part (a group's text).

    The text between matches and the matches themselves alternate, so running lengths give the
    offsets. They are summed in blocks of about the root of the number of matches: appending to an
    array copies it, and blocks keep the copies at n ** 1.5. `guard` is a cheap test that every text
    with a match passes.
    """
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(part)).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text"), x["p"].alias("part"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def join(acc: Column, block: Column) -> Column:
        shifted = F.transform(block["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["text"].alias("text"), x["part"].alias("part")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], shifted).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def positioned(every: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(every))).cast("int")
        starts = F.sequence(F.lit(1), F.size(every), width)
        return F.aggregate(F.transform(starts, lambda k: F.aggregate(F.slice(every, k, width), empty, step)), empty, join, lambda acc: acc["out"])

    found = let(F.filter(zipped, lambda x: x["m"].isNotNull()), positioned)
    hit = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    return F.when(hit, found).otherwise(no_spans())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def kind_spans(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Sequence[Column] | Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    every = spans if isinstance(spans, Column) else F.concat(*spans)
    return F.array_join(F.transform(F.array_sort(every), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
