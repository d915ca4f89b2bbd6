"""Ranked search over the tiered index against DuckDB and against plain Python, with items that need different tiers."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from corrgrid.llm import tiered
from corrgrid.llm.queries import ORACLES, QUERIES
from corrgrid.llm.tiered import ranked_search

DIR = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    words = [(i, found(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        asked, scores = {t for i, x in items if i == item for t in found(x)}, []
        for i, w in words:
            tf, m = Counter(w), 10 + 90 * len(w) * n_docs // max(1, n_terms)
            s = sum(weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in asked if tf[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def test_query_against_duckdb(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = sorted(map(tuple, QUERIES["op11_search_tiered"](spark, DIR).collect()))
    assert len(got) > 100 and got == sorted(duck.execute(ORACLES["op11_search_tiered"]).fetchall())


@pytest.mark.parametrize("seed, block_terms", [(1, 200_000), (2, 40)])
def test_items_fall_through(spark, seed, block_terms, monkeypatch):
    monkeypatch.setattr(tiered, "SHARD", 64)
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(names[min(399, int(rng.paretovariate(0.7)) - 1)] for _ in range(n))
    docs = [(i, text(rng.randrange(1, 120))) for i in range(700)] + [(5, text(9)), (5, "w0 w1"), (None, text(30)), (900, None), (901, "W3 W3, w3-É é")]
    items = [(0, "w0 w1 w2"), (1, "w300 w301 w0"), (2, " ".join(names[50:90])), (3, "absent"), (4, None), (5, docs[3][1]), (6, "w398"), (6, "w0"), (None, "w1"), (7, "É w3")]
    trace = {}
    got = ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=5, block_terms=block_terms, trace=trace)
    assert sorted(map(tuple, got.collect())) == plain(docs, items, 5)
    assert len(set(trace.values())) > 1 and set(trace) == {0, 1, 2, 3, 5, 6, 7}


def test_corners(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, "a"), (3, ""), (4, "a " * 30000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, ""), (None, "a")], "item_id long, text string")
    clash = lambda df: df.selectExpr("*", "7 AS item", "7 AS term", "7 AS terms", "7 AS shard", "7 AS n", "7 AS tfs", "7 AS score", "7 AS rank")
    rows = lambda d, q: sorted(map(tuple, ranked_search(d, q).collect()))
    assert rows(docs, items) == rows(clash(docs), clash(items)) == plain([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], 10)
    assert rows(docs.where("false"), items) == rows(docs, items.where("false")) == []
