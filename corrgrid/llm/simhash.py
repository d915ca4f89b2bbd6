"""Near-duplicates by SimHash with the generalised pigeonhole principle.

Equal fingerprints collapse into one class first. The 64 bits are grouped into parts so that
correlated bits share a part; thresholds t_i per part with sum(t_i + 1) = radius + 1 guarantee that
any two fingerprints within the radius agree within t_i in some part i. Dynamic programming picks
the parts' thresholds (-1 skips a part) for the least estimated number of probes and candidates;
probing and verifying are equi-joins on (part, projection). A projection that very many
fingerprints share does not emit its pairs: its members are linked through the fingerprints between
them, within half the radius of one and the rest of it from the other.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrgrid.llm.common import small_batches, staged
from corrgrid.llm.components import components

BITS = 64
#: Fingerprints on which bit correlations and candidate counts are estimated, smallest hashes first.
SAMPLE = 2_000
#: A projection with more members than this is linked by stars instead of pairs.
HOT_MEMBERS = 48

_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(raw: bytes, width: int) -> int:
    """64 majority bits of XXH64 (seed 42) over the word shingles of a UTF-8 text."""
    words = raw.lower().split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        digests, n = hashed(joined, 42), 1
    else:
        ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *[e + 1 for e in ends]]
        digests = b"".join([hashed(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=False)])
        n = len(words) - width + 1
    cells = np.frombuffer(digests, np.uint8).reshape(n, 8) + _COLUMN
    ones = np.einsum("kv,vb->kb", np.bincount(cells.ravel(), minlength=2048).reshape(8, 256), _BIT)
    return int.from_bytes(np.packbits((2 * ones > n).ravel()).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py() or b"", width) for x in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _parts(bits: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal width; each takes the bits most correlated with those it has."""
    with np.errstate(invalid="ignore"):
        corr = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((BITS, BITS))
    free, parts = set(range(BITS)), []
    for k in range(m):
        want = (BITS - sum(map(len, parts))) // (m - k)
        part = [min(free, key=lambda b: (-corr[b, list(free)].sum(), b))]
        free.discard(part[0])
        while len(part) < want:
            part.append(best := min(free, key=lambda b: (-corr[b, part].sum(), b)))
            free.discard(best)
        parts.append(sorted(part))
    return parts


def allocate(sample: Sequence[int], n: int, radius: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds of least estimated work for n distinct fingerprints."""
    raw = np.array(sample, dtype=np.int64).astype(">i8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(raw, axis=1).astype(np.int8) if len(sample) else np.zeros((1, BITS), np.int8)
    ones = bits.mean(axis=0)
    alike = np.clip(ones**2 + (1 - ones) ** 2, 0.5, 1 - 1e-9)
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in range(1, min(radius + 2, 8)):
        parts = _parts(bits, m)
        costs = []
        for part in parts:
            near = np.zeros(radius + 1)
            near[0] = 1.0  # chance of each number of differing bits, bit by bit
            for b in part:
                near = near * alike[b] + np.concatenate([[0], near[:-1]]) * (1 - alike[b])
            if len(bits) > 1:
                x = bits[:, part].astype(np.float32)
                apart = len(part) - (x @ x.T + (1 - x) @ (1 - x).T)
                seen = np.array([(np.round(apart[np.triu_indices(len(x), 1)]) == t).mean() for t in range(radius + 1)])
                near = np.maximum(near, np.where(seen * len(x) ** 2 > 8, seen, 0))
            probes = [sum(math.comb(len(part), j) for j in range(t + 1)) for t in range(radius + 1)]
            costs.append([0.0, *[n * probes[t] * 4.0 + n * n / 2 * near[: t + 1].sum() for t in range(radius + 1)]])
        table = {0: (0.0, [])}  # budget used so far, in units of t + 1
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in table.items():
                for t1 in range(radius + 2 - used):
                    if (new := c + cost[t1]) < step.get(used + t1, (math.inf,))[0]:
                        step[used + t1] = (new, [*ts, t1 - 1])
            table = step
        cost, ts = table[radius + 1]
        if cost < best[0]:
            best = cost, [(p, t) for p, t in zip(parts, ts, strict=True) if t >= 0]
    return best[1]


def _mask(bits: Sequence[int]) -> int:
    value = sum(1 << (BITS - 1 - b) for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _flips(bits: Sequence[int], radius: int) -> Column:
    """Masks of at most `radius` of the bits."""
    masks = [_mask(c) for k in range(radius + 1) for c in itertools.combinations(bits, k)]
    return F.array(*[F.lit(m).cast("long") for m in masks])


def links(classes: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) between classes (fp, node); every two classes within the radius are connected."""
    n = classes.count()
    sample = [r.fp for r in classes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect()]
    plan = allocate(sample, n, radius)
    project = lambda i, bits: F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits)).cast("long")).alias("key"))
    index = classes.select("fp", "node", F.inline(F.array(*[project(i, bits) for i, (bits, _) in enumerate(plan)])))
    plain = all(t == 0 for _, t in plan)
    probe = index
    if not plain:
        variants = lambda bits, t: F.transform(_flips(bits, t), lambda m: F.col("fp").bitwiseAND(F.lit(_mask(bits)).cast("long")).bitwiseXOR(m))
        tables = [classes.select("fp", "node", F.lit(i).alias("part"), F.explode(variants(bits, t)).alias("key")) for i, (bits, t) in enumerate(plan)]
        probe = tables[0]
        for x in tables[1:]:
            probe = probe.unionByName(x)
    size = index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("members"))
    if plain:
        size = size.where("members > 1")
        index = staged(index.join(size, ["part", "key"]))
        probe = index
    else:
        index, probe = index.join(size, ["part", "key"]), probe.join(size, ["part", "key"])
    a, b = index.where(F.col("members") <= HOT_MEMBERS), probe.where(F.col("members") <= HOT_MEMBERS)
    a, b = a.select("part", "key", F.col("fp").alias("fp_a"), F.col("node").alias("u")), b.select("part", "key", F.col("fp").alias("fp_b"), F.col("node").alias("v"))
    close = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= radius
    order = F.col("fp_a") < F.col("fp_b") if plain else F.col("fp_a") != F.col("fp_b")
    edges = a.join(b, (a.part == b.part) & (a.key == b.key) & order & close).select("u", "v")
    # Around crowded projections: two fingerprints lie within the radius exactly if some spot is within
    # half of it from one and within the rest from the other. All near ones of a spot link to its least.
    hot = (index if plain else index.unionByName(probe)).where(F.col("members") > HOT_MEMBERS).select("fp", "node").distinct()
    half = radius // 2
    spread = hot.select("fp", "node", F.explode(F.transform(_flips(range(BITS), radius - half), lambda m: F.col("fp").bitwiseXOR(m))).alias("spot"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("spot"))) <= half
    spots = spread.groupBy("spot").agg(F.min(F.when(near, F.col("node"))).alias("u"), F.count(F.lit(1)).alias("k")).where("k > 1 and u is not null")
    edges = edges.unionByName(spread.join(spots, "spot").where("node <> u").select("u", F.col("node").alias("v")))
    return edges


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    A-Z are lower-cased; words end at ASCII white space; a text with fewer than `width` words is one
    shingle, a text without words (also null) has fingerprint zero and is linked like any other.
    Fingerprints within `radius` bits are linked; component_id is the smallest doc_id reachable,
    itself included. Repeated rows get equal rows. Rows whose doc_id is null are returned with the
    component of their fingerprint, or null if no row with an id has it. Empty tables give no rows.
    """
    rows = staged(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    classes = staged(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    edges = links(classes, radius)
    comp = components(edges)
    named = classes.join(comp, classes.node == comp.node, "left").select("fp", F.coalesce("component", classes.node).alias("component_id"))
    return rows.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
