"""Near copies by the Jaccard similarity of word shingles; every pair at or above the threshold is found.

Candidates come first from SimHash: fingerprints of the same shingles that differ in at most RADIUS
bits, by partitions of correlated bits (simhash.links). Fingerprints alone miss most pairs near the
threshold, so an exact join of shingle prefixes finds the rest. Every candidate is verified.

Shingles have one order in all documents: by hash, those that are frequent in a sample last. Two
documents that reach the threshold share a shingle among the first n - ceil(threshold n) + 1 of
each, so only these prefixes are joined, and each candidate pair is verified on its whole shingle
sets. Candidates of a shingle's least document come first; a shingle whose documents they connect
needs no more pairs, so large groups cost rows and not squares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrgrid.llm.common import BROADCAST_IDS, broadcast_if_small, discard, own_worker, small_batches, staged, without
from corrgrid.llm.components import components
from corrgrid.llm.simhash import fingerprints, links

#: Words per shingle, and the least similarity as numerator and denominator.
WIDTH, SIMILAR = 5, (4, 5)
#: Bits in which the fingerprints of first candidates differ at most.
RADIUS = 2
#: One document in so many is sampled for frequent shingles (in three of them); the commonest so many
#: stand last in the order. Any order finds the same pairs.
SAMPLED, FREQUENT = 16, 200_000
#: Bytes of shingles per batch.
BATCH_BYTES = 4 << 20


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the word shingles; fewer words are one shingle."""
    words, hashed = raw.lower().split(), xxhash.xxh64_digest
    n = max(1, len(words) - width + 1)
    digests = b"".join([hashed(b" ".join(words[i : i + width]), 42) for i in range(n)])
    return np.unique(np.frombuffer(digests, ">u8").astype(np.int64))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw"))


def _chunks(rows: Iterator[tuple[int, np.ndarray]]) -> Iterator[list[tuple[int, np.ndarray]]]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += row[1].nbytes
        if size >= BATCH_BYTES:
            yield out
            out, size = [], 0
    yield out


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray]]:
    own_worker("near_copies")
    for batch in batches:
        for i, raw in zip(batch.column("doc_id"), batch.column("raw"), strict=True):
            yield i.as_py(), shingles(raw.as_py(), width)


def prefixes(texts: DataFrame, width: int, similar: tuple[int, int], frequent: np.ndarray) -> DataFrame:
    """doc_id, n (distinct shingles), keys: the shingles of which similar documents share one."""
    num, den = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(_sets(batches, width)):
            keys = []
            for _, s in chunk:
                late = np.isin(s, frequent, assume_unique=True) if len(frequent) else np.zeros(len(s), bool)
                keys.append(np.concatenate([s[~late], s[late]])[: len(s) + (-num * len(s)) // den + 1])
            ids, n = pa.array([i for i, _ in chunk], pa.int64()), pa.array([len(s) for _, s in chunk], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, n, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "keys"])

    return texts.mapInArrow(run, "doc_id long, n long, keys array<long>")


def frequent_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """The commonest shingles of a sample of the documents, sorted."""
    part = prefixes(texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0), width, (0, 1), np.zeros(0, np.int64))
    counts = part.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k >= 3")
    return np.sort(np.array([r.key for r in counts.orderBy(F.desc("k"), "key").limit(FREQUENT).collect()], np.int64))


def verified(texts: DataFrame, pairs: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose whole shingle sets reach the similarity, staged."""
    num, den = similar
    ids = staged(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(_sets(batches, width)):
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunk], pa.int64()), pa.array([s for _, s in chunk], pa.list_(pa.int64()))], ["doc_id", "shingles"])

    wanted = texts.join(broadcast_if_small(ids, ids.count(), BROADCAST_IDS), "doc_id", "left_semi")
    sets = staged(wanted.mapInArrow(pack, "doc_id long, shingles array<long>"))
    side = lambda k, c: sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(c))
    both = F.size(F.array_intersect("a", "b"))
    good = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").where(both * den >= (F.size("a") + F.size("b") - both) * num)
    out = staged(good.select("u", "v").distinct())
    discard(sets)
    discard(ids)
    return out


def _reaches(most: Column, similar: tuple[int, int]) -> Column:
    """Whether sets of n and m shingles with at most so many in common can reach the similarity."""
    num, den = similar
    n, m = F.col("n"), F.col("m")
    return (most * (num + den) >= (n + m) * num) & (F.least(n, m) * den >= F.greatest(n, m) * num)


def _possible(similar: tuple[int, int]) -> Column:
    """Whether a shared shingle at the positions (pos, at) may be the pair's first: as many as similar
    sets have in common must stand from there on in both. Similar pairs share at least one such."""
    return _reaches(F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")), similar)


def alike(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Pairs (u, v) of documents whose SimHash fingerprints are linked: members with their class's least, classes with each other."""
    prints = staged(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col=id_col, text_col=text_col, width=width))
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    members = prints.join(classes, "fp").where("doc_id > node").select(F.col("node").alias("u"), F.col("doc_id").alias("v"))
    near = links(classes, RADIUS).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return staged(members.unionByName(near).distinct())


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """node, component: of each document linked to a lesser one, the smallest doc_id of its group.

    Documents are linked if the Jaccard similarity of their sets of `width`-word shingles is at least
    `similar`; groups are closed under links. A-Z are lower-cased and words end at ASCII white space;
    a text with fewer words is one shingle. Rows that repeat an id are taken to repeat its text; rows
    whose id is null take no part.
    """
    texts = _texts(docs, id_col, text_col)
    rows = staged(prefixes(texts, width, similar, frequent_shingles(texts, width)))
    flat = rows.select("doc_id", "n", F.posexplode("keys").alias("pos", "key"))
    shared = staged(flat.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key"))
    hits = staged(flat.join(broadcast_if_small(shared, shared.count(), BROADCAST_IDS), "key"))
    discard(rows)
    discard(shared)
    least = hits.groupBy("key").agg(F.min(F.struct(F.col("doc_id").alias("u"), F.col("n").alias("m"), F.col("pos").alias("at"))).alias("least")).select("key", "least.*")
    stars = hits.join(least, "key").where((F.col("doc_id") > F.col("u")) & _possible(similar)).select("u", F.col("doc_id").alias("v"))
    stars = staged(stars.unionByName(alike(docs, id_col, text_col, width)).distinct())
    first = verified(texts, stars, width, similar)
    # Shingles whose documents are not all connected yet: all pairs across groups.
    found = staged(components(first))
    labelled = hits.join(found, hits.doc_id == found.node, "left").select("key", "doc_id", "n", "pos", F.coalesce("component", "doc_id").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    rest = staged(labelled.join(mixed, "key"))
    other = rest.select("key", F.col("doc_id").alias("u"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("label").alias("group"))
    met = rest.join(other, "key").where((F.col("doc_id") > F.col("u")) & (F.col("label") != F.col("group")) & _possible(similar))
    # Shared shingles that are not met here can only stand after the last that is.
    pairs = met.groupBy("u", F.col("doc_id").alias("v"), "n", "m").agg(F.count(F.lit(1)).alias("both"), F.max("pos").alias("pos"), F.max("at").alias("at"))
    pairs = pairs.where(_reaches(F.col("both") + F.least(F.col("n") - F.col("pos") - 1, F.col("m") - F.col("at") - 1), similar)).select("u", "v")
    second = verified(texts, staged(pairs.distinct().join(stars, ["u", "v"], "left_anti")), width, similar)
    discard(rest)
    discard(hits)
    return components(first.unionByName(second))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The rows of docs whose id is the smallest of their group, with all their columns.

    Rows whose id is null stay; rows that repeat an id stay or go together; null and empty texts are
    one shingle and so copies of each other; empty tables give none; further columns may have any name.
    """
    found = near_copies(docs, id_col=id_col, text_col=text_col, width=width, similar=similar)
    return without(docs, found.select(F.col("node").alias(id_col)).distinct(), id_col)
