"""A corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrgrid.llm.bpe import encode_documents
from corrgrid.llm.common import staged, table
from corrgrid.llm.exact_dedup import keep_first
from corrgrid.llm.mixing import repeat_copies
from corrgrid.llm.near_copies import keep_one
from corrgrid.llm.toxicity import drop_toxic
from corrgrid.staging import scope


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id stays."""
    return keep_first(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word Jaccard similarity of 0.8 or more stays; SimHash candidates first."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the entropy-balanced mix takes it: 0, 1 or 2 times."""
    return repeat_copies(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to."""
    out = encode_documents(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_near_dedup", simhash_near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: Scoring, fingerprints, balancing and merging are not SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. What a stage staged goes once its output is written; other results' tables stay."""
    docs = table(spark, sf_dir, "documents")
    with scope() as mine:
        for name, stage in STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != STAGES[-1][0]:
                docs = staged(docs)
                mine.discard(spark, keep=docs)  # nothing reads earlier stages any more
    return docs
