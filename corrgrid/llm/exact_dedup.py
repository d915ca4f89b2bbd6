"""Exact deduplication with a log-structured merge index of digests (native).

Each input task is a memtable: it flushes one run file, sorted by digest and carrying a Parquet
Bloom filter, so that point look-ups skip run files. Compaction merges all runs and keeps the
smallest identifier and the count of every digest. Digests that occur more than once are hits;
their texts are read again, met by digest and compared byte for byte, and a group whose texts
differ is split by its texts. Ids only name rows in the result; no join uses them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrgrid.llm.common import SPACES, broadcast_if_small, discard, fresh, staged, text_or_empty, without

#: Run files hold a filter on their digests.
RUN_OPTIONS = {"parquet.bloom.filter.enabled#digest": "true"}
#: Hits up to this many rows (16 bytes each) filter the second read as a broadcast; more are joined.
BROADCAST_HITS = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def flush_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """Level 0: one row per document, (digest, text_sha, doc_id, rid), sorted by digest in each run file."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(text_or_empty(text_col)).alias("norm"))
    sha = F.sha2("norm", 256)
    rows = norm.select(F.unhex(sha).alias("text_sha"), digest(F.col("norm")).alias("weak") if digest else F.lit(None).cast("binary").alias("weak"), "doc_id")
    rows = rows.select(F.coalesce("weak", "text_sha").alias("digest"), "text_sha", "doc_id", F.monotonically_increasing_id().alias("rid"))
    return staged(rows.sortWithinPartitions("digest", "doc_id"), options=RUN_OPTIONS)


def compact(runs: DataFrame) -> DataFrame:
    """Level 1: of each digest the smallest entry (null ids last) and the number of documents.

    The partial aggregate merges inside each run first, so a digest that many documents share
    reaches the exchange once per task.
    """
    entry = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    return runs.groupBy("digest").agg(F.min(entry).alias("first"), F.count(F.lit(1)).alias("group_size"))


def probe(runs: DataFrame, digests: list[bytes]) -> DataFrame:
    """Entries of given digests; Parquet's run statistics and Bloom filters skip the other files."""
    return runs.where(F.col("digest").isin([F.lit(x) for x in digests]))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space. Null texts
    count as empty, empty texts equal each other. Of rows with equal texts, the one with the smallest
    id is kept, a null id only if there is no other; of repeated rows with that id exactly one is
    kept. Empty tables give no rows; further columns are ignored. `digest` replaces SHA-256 as the
    index key (tests use a weak one); its collisions are found by the byte comparison.
    """
    runs = flush_runs(docs, id_col, text_col, digest)
    level = staged(compact(runs), options=RUN_OPTIONS)
    hits = staged(level.where("group_size > 1").select("digest"))
    n_hits = hits.count()
    rows = runs.join(level, "digest")
    out = rows.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), F.lower(F.hex("text_sha")).alias("text_sha256"), "digest")
    if not n_hits:
        return out.drop("digest")
    # Byte verification of every hit's texts, joined by digest: least and greatest text of a digest are
    # equal exactly if all its texts are, and the partial aggregate keeps two texts per digest and task.
    norm = docs.select(normalised(text_or_empty(text_col)).alias("norm"))
    own = digest(F.col("norm")) if digest else F.unhex(F.sha2("norm", 256))
    reread = norm.select("norm", own.alias("digest")).join(broadcast_if_small(hits, n_hits, BROADCAST_HITS), "digest", "left_semi")
    mixed = staged(reread.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a <> b").select("digest"))
    discard(hits)
    if mixed.isEmpty():
        return out.drop("digest")
    # A digest that several texts share: regroup its rows by the texts' own SHA-256.
    split = runs.join(mixed, "digest", "left_semi")
    again = split.groupBy("digest", "text_sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    fixed = split.join(again, ["digest", "text_sha"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), F.lower(F.hex("text_sha")).alias("text_sha256"))
    return out.join(mixed, "digest", "left_anti").drop("digest").unionByName(fixed)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Null and empty texts equal each other; of rows that repeat an id and a text one stays, whichever;
    a null id stays only if no other row has its text; further columns may have any name; empty
    tables give none.
    """
    found = staged(exact_dedup(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), "kept", "text_sha256"))
    rows, ids = found.agg(F.count(F.lit(1)), F.countDistinct(id_col)).first()
    if rows == ids:
        return without(docs, found.where("not kept").select(id_col), id_col)
    # Repeated or null ids: an id alone does not name a row, id and text do.
    key, sha, own = fresh(docs, "kept_id", "kept_sha", "own_sha")
    kept = found.where("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(sha)).distinct()
    keyed = docs.withColumn(own, F.sha2(normalised(text_or_empty(text_col)), 256))
    joined = keyed.join(kept, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(own) == F.col(sha)), "left_semi")
    return joined.dropDuplicates([id_col, own]).select(docs.columns)
