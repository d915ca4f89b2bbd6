"""Ranked lexical search over a tiered index.

The index is dealt over shards of documents; a shard is one row whose columns hold the postings of its
documents by term in tiers of falling impact. Queries first read the columns of the first tier only.
Every document's partial score is a lower bound of its score; the residual bound of a term, its
greatest impact in the lower tiers anywhere, bounds what a document may still gain from it. An item is
proven at a tier when a document that no read posting names cannot reach the k-th lower bound; items
without that proof fall through: the next scan reads one more tier for them. Documents whose upper
bound reaches the k-th lower bound are then scored exactly from all tiers, in the shards that hold them.

Items are dealt into blocks of a bounded number of terms, so what travels to tasks is bounded; every
scan covers all documents and moves at most k rows per item and shard.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrgrid.llm.common import BROADCAST_IDS, broadcast_if_small, discard, small_batches, staged

#: What a term is made of, and the letters that are lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same by UTF-8 bytes: separators become spaces, capitals small letters.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Share of all postings in the first tier, in the first two, and so on; any cuts give the same result.
SHARES = (1 / 4, 3 / 4, 15 / 16)
#: Documents of a shard, and terms of a block of items (with repeats).
SHARD, BLOCK_TERMS = 4_096, 200_000
#: Groups of shards whose best are merged before those of an item are.
MERGE = 64
UNIT = 1_000_000_000


def terms(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shards are long rows: few of them make an Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def forward(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (all terms), and the vocabulary's terms with their occurrences, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            n, found, times = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().translate(BYTES).split()
                hits = [(t, c) for w, c in Counter(words).items() if (t := get(w)) is not None]
                n.append(len(words))
                found.append([t for t, _ in hits])
                times.append([c for _, c in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def impact(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * (UNIT * tf // (1000 * tf + 8 * m))


class Index:
    """Names of the tiers' columns, weights and cuts; builds shards and reads them."""

    def __init__(self, n_docs: int, n_terms: int, df: np.ndarray) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        order = np.argsort(-self.weight, kind="stable")
        share = np.cumsum(df[order]) / max(1, df.sum())
        at = [min(int(np.searchsorted(share, s)), len(df) - 1) for s in SHARES]
        self.cuts = np.array([int(self.weight[order[k]]) * (UNIT // 1800) for k in at] if len(df) else [0] * len(SHARES), np.int64)
        self.tiers = len(SHARES) + 1

    def columns(self, tier: int) -> list[str]:
        return [f"t{tier}_{x}" for x in ("terms", "starts", "docs", "tfs", "most")]

    def schema(self) -> str:
        kinds = ("array<int>", "array<int>", "array<int>", "array<int>", "array<bigint>")
        return "shard long, ids array<bigint>, m array<bigint>, " + ", ".join(f"{c} {k}" for j in range(self.tiers) for c, k in zip(self.columns(j), kinds, strict=True))

    def build(self, rows: DataFrame) -> DataFrame:
        names = [x.split(" ")[0] for x in self.schema().split(", ")]
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())

        def shard(key: int, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
            m = 10 + 90 * n * self.n_docs // self.n_terms
            value = impact(self.weight[term], tf, m[doc])
            tier = (value[:, None] < self.cuts[None, :]).sum(axis=1)
            out = [pa.array([key]), pa.array([ids], longs), pa.array([m], longs)]
            for j in range(self.tiers):
                own = np.flatnonzero(tier == j)
                own = own[np.lexsort((-value[own], term[own]))]
                found, starts = np.unique(term[own], return_index=True)
                most = value[own][starts]
                out += [pa.array([x], ints) for x in (found, np.append(starts, len(own)), doc[own], tf[own])] + [pa.array([most], longs)]
            return pa.RecordBatch.from_arrays(out, names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, held, key = [], 0, TaskContext.get().partitionId() << 32

            def flush() -> pa.RecordBatch:
                sizes = np.concatenate([np.diff(b.column("terms").offsets.to_numpy()) for b in kept])
                whole = lambda c: np.concatenate([b.column(c).flatten().to_numpy() for b in kept]).astype(np.int64)
                flat = lambda c: np.concatenate([b.column(c).to_numpy() for b in kept])
                return shard(key, flat("doc_id"), flat("n"), np.repeat(np.arange(len(sizes)), sizes), whole("terms"), whole("tfs"))

            for batch in batches:
                for at in range(0, batch.num_rows, SHARD):
                    kept.append(batch.slice(at, SHARD))
                    held += kept[-1].num_rows
                    if held >= SHARD:
                        yield flush()
                        kept, held, key = [], 0, key + 1
            if held:
                yield flush()

        return rows.where("doc_id is not null and size(terms) > 0").mapInArrow(run, self.schema())

    def residuals(self, index: DataFrame) -> np.ndarray:
        """[j, t]: the greatest impact of term t below tier j."""
        out = np.zeros((self.tiers, len(self.weight)), np.int64)
        parts = [index.select(F.lit(j).alias("tier"), F.explode(F.arrays_zip(F.col(f"t{j}_terms").alias("term"), F.col(f"t{j}_most").alias("most"))).alias("x")) for j in range(1, self.tiers)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionAll(p)
        for r in rows.groupBy("tier", F.col("x.term").alias("term")).agg(F.max("x.most").alias("most")).collect():  # tiers x terms of the block
            out[: r.tier, r.term] = np.maximum(out[: r.tier, r.term], r.most)
        return out


class Shard:
    """One shard's postings in the tiers that were read."""

    def __init__(self, index: Index, batch: pa.RecordBatch, i: int, tiers: range) -> None:
        get = lambda c: batch.column(c)[i].values.to_numpy()
        self.m, self.tiers = get("m"), []
        for j in tiers:
            found, starts, docs, tfs, _ = (get(c) for c in index.columns(j))
            value = impact(np.repeat(index.weight[found], np.diff(starts)), tfs.astype(np.int64), self.m[docs])
            self.tiers.append((found, starts, docs, value))

    def of(self, j: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, impacts and terms of a tier's postings of the wanted terms (ascending)."""
        found, starts, docs, value = self.tiers[j]
        at = np.searchsorted(found, wanted)
        at = at[found[np.minimum(at, len(found) - 1)] == wanted] if len(found) else at[:0]
        spans = [slice(starts[a], starts[a + 1]) for a in at]
        if not spans:
            return docs[:0], value[:0], docs[:0]
        return np.concatenate([docs[s] for s in spans]), np.concatenate([value[s] for s in spans]), np.repeat(found[at], starts[at + 1] - starts[at])

    def sums(self, docs: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Per document, exact while below 2^53: weights stay below 10^5, impacts below 10^11."""
        return np.bincount(docs, values, len(self.m)).astype(np.int64)

    def partial(self, wanted: np.ndarray, upto: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Partial scores from tiers 0 to upto, and (documents, terms) of the postings met."""
        parts = [self.of(j, wanted) for j in range(upto + 1)]
        docs, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return self.sums(docs, values), [(p[0], p[2]) for p in parts]


def best(rows: DataFrame, k: int, *by: Column) -> DataFrame:
    """The k first rows of each item in this order, merged from groups of shards; rank from 1."""
    part = Window.partitionBy("item", F.pmod(F.xxhash64("shard"), F.lit(MERGE))).orderBy(*by)
    rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k)


def search_block(docs: DataFrame, items: list[tuple[int, list[str]]], k: int, id_col: str, text_col: str, trace: dict[int, int] | None) -> DataFrame:
    """item (place in items), rank, doc_id, score of one block of items."""
    spark = docs.sparkSession
    names = sorted({t for _, found in items for t in found})
    code = {t: i for i, t in enumerate(names)}
    wanted = [np.array(sorted(code[t] for t in found), np.int64) for _, found in items]
    rows = staged(forward(docs, {t.encode(): i for t, i in code.items()}, id_col, text_col))
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # terms of the block
        df[r.term] = r["count"]
    index = Index(n_docs, max(1, n_terms), df)
    with batches_of(spark, 4):
        shards = staged(index.build(rows), options={"parquet.block.size": str(32 << 20)})
        discard(rows)
        residual = index.residuals(shards)
        floor = np.zeros(len(items), np.int64)
        level = np.full(len(items), -1)
        for j in range(index.tiers):
            active = np.flatnonzero(level < 0)
            if not len(active):
                break

            def bounds(batches: Iterator[pa.RecordBatch], active: np.ndarray = active, floor: np.ndarray = floor, j: int = j) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(batch.num_rows):
                        shard, found, scores = Shard(index, batch, i, range(j + 1)), [], []
                        for q in active:
                            s, _ = shard.partial(wanted[q], j)
                            s = s[s >= max(1, floor[q])]
                            s = np.partition(s, len(s) - k)[-k:] if len(s) > k else s
                            found.append(np.full(len(s), q))
                            scores.append(s)
                        found, scores = np.concatenate(found), np.concatenate(scores)
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.full(len(found), batch.column("shard")[i].as_py())), pa.array(scores, pa.int64())], ["item", "shard", "score"])

            read = shards.select("shard", "m", *[c for t in range(j + 1) for c in index.columns(t)])
            found = best(read.mapInArrow(bounds, "item int, shard long, score long"), k, F.desc("score"))
            for r in found.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).collect():  # a row per item of the block
                if r.n == k:
                    floor[r["item"]] = max(floor[r["item"]], r.least)
            rest = np.array([residual[j][wanted[q]].sum() for q in active])
            proven = active[(rest < floor[active]) | (j == index.tiers - 1)]
            level[proven] = j
        if trace is not None:
            trace |= {items[q][0]: int(level[q]) for q in range(len(items))}

        def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Documents that may be among the k best, by their upper bounds."""
            for batch in batches:
                for i in range(batch.num_rows):
                    shard, found, at = Shard(index, batch, i, range(int(level.max()) + 1)), [], []
                    for q, terms_of_item in enumerate(wanted):
                        j = level[q]
                        s, met = shard.partial(terms_of_item, j)
                        rest = residual[j][terms_of_item].sum() - shard.sums(np.concatenate([d for d, _ in met]), residual[j][np.concatenate([t for _, t in met])])
                        own = np.flatnonzero((s > 0) & (s + rest >= floor[q]))
                        found.append(np.full(len(own), q))
                        at.append(own)
                    found, at = np.concatenate(found), np.concatenate(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), batch.column("shard")[i].as_py())), pa.array(found, pa.int32()), pa.array(at, pa.int32())], ["shard", "item", "at"])

        read = shards.select("shard", "m", *[c for t in range(int(level.max(initial=0)) + 1) for c in index.columns(t)])
        asked = staged(read.mapInArrow(candidates, "shard long, item int, at int").groupBy("shard").agg(F.collect_list("item").alias("asked"), F.collect_list("at").alias("at")))

        def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Exact scores of the candidates, the k best of each item and shard."""
            for batch in batches:
                for i in range(batch.num_rows):
                    get = lambda c: batch.column(c)[i].values.to_numpy()  # noqa: B023, E731
                    shard, ids, item, at = Shard(index, batch, i, range(index.tiers)), get("ids"), get("asked"), get("at")
                    out = [[], [], []]
                    for q in np.unique(item):
                        own = at[item == q]
                        mine = np.zeros(len(ids), bool)
                        mine[own] = True
                        parts = [shard.of(j, wanted[q])[:2] for j in range(index.tiers)]
                        d, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                        score = shard.sums(d[mine[d]], v[mine[d]])[own]
                        order = np.lexsort((ids[own], -score))[:k]
                        for column, x in zip(out, (np.full(len(order), q), ids[own][order], score[order]), strict=True):
                            column.append(x)
                    item, doc, score = map(np.concatenate, out)
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(np.full(len(item), batch.column("shard")[i].as_py())), pa.array(doc), pa.array(score)], ["item", "shard", "doc_id", "score"])

        # The lists of a shard are bounded by its documents times the items of the block.
        sent = shards.join(broadcast_if_small(asked, asked.select(F.sum(F.size("at"))).first()[0] or 0, BROADCAST_IDS), "shard")
        scored = sent.mapInArrow(complete, "item int, shard long, doc_id long, score long").where("score > 0")
        out = staged(best(scored, k, F.desc("score"), F.asc("doc_id")).select("item", F.col("rank").cast("int"), "doc_id", "score"))
    discard(shards)
    discard(asked)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 10, block_terms: int = BLOCK_TERMS, trace: dict[int, int] | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents, equal scores by ascending doc_id.

    A document's score sums the impacts of the item's distinct terms in it. Null texts have no terms;
    items without terms and items that no document matches give no rows. Rows with equal item_id are
    one item; a null item_id takes no part. Repeated documents each count and rank; documents with a
    null id count in all statistics but are not returned. Empty tables give no rows; further columns
    are ignored. `trace` receives the last tier that each item needed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.explode(F.array_distinct(terms(F.col(item_text_col)))).alias("term"))
    asked = staged(found.groupBy("item_id").agg(F.collect_set("term").alias("terms")))
    blocks = -(-(asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // block_terms)
    out = None
    for b in range(blocks):
        block = [(r.item_id, r.terms) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]  # about block_terms terms
        if block:
            names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], "item int, item_id long")
            got = search_block(docs, block, k, id_col, text_col, trace).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
            out = got if out is None else out.unionAll(got)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SEARCH_SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents),
         c AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
         p AS (SELECT nr, doc_id, n, term, count(*) AS tf FROM (SELECT nr, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
         w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, n_docs),
         q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
         s AS (SELECT item_id, nr, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
               FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10"""
