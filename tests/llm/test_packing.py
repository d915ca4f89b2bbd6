"""Packing: ids as the library gives them, gapless sequences, bounded padding, and best-fit decreasing piece by piece."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corrgrid.llm.packing import Plan, Words, best_fit, default_vocabulary, pack_digests, pack_documents, sequences

DIR = "/root/testdata/sf0.001"
TRICKY = ["Abc<|endoftext|>x, foo's it's\x85n'T x <|startoftext|>", "a ́b É́ ß.. İstanbul ΣΑΣ. ﬁ 123a4 ... '' x'", "\x1ca\x1fb\xa0d <|ENDOFTEXT|> z", "Don'T. STOP!x a.b,c É. ÀÉ \xaa\xb5\xba a&b#c"]


@pytest.fixture(scope="module")
def words():
    return Words(default_vocabulary())


def test_ids_are_the_librarys(words):
    flat, at = words.encode(pa.array([*TRICKY, None, "", *TRICKY]), 2)
    for i, t in enumerate([*TRICKY, "", "", *TRICKY]):
        assert flat[at[i] : at[i + 1]].tolist() == [*words.library.encode(t, add_special_tokens=False).ids, 2], t


def naive(lengths, window):
    """Tokens used per window by best-fit decreasing, one piece at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(window - n)
    return sorted(window - r for r in room)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [min(64, 1 + int(rng.expovariate(rng.choice([0.02, 0.1, 0.5])))) for _ in range(rng.randrange(1, 400))]
    runs, ranges = best_fit(Counter(lengths), 64)
    assert sorted(u for _, n, u in ranges for _ in range(n)) == naive(lengths, 64)
    plan = Plan(Counter(lengths), 64, 4)
    used, placed = defaultdict(list), Counter()
    for n in lengths:
        whole, seq, at = plan.place(np.array([n]), np.array([placed[n]]))
        placed[n] += 1
        for _, m, s, o in [(0, n, int(seq[0]), int(at[0]))] if whole[0] else plan.cuts(int(at[0]), n):
            used[s].append((o, m))
    assert sorted(used) == list(range(len(used)))
    for parts in used.values():
        end = 0
        for o, m in sorted(parts):
            assert o == end
            end += m
        assert end <= 64 and (64 - end <= 4 or end.bit_count() == 1)


def test_every_document(spark, words):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, "word " * 30000), (10**6 + 1, None)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    whole = {i: [*words.library.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    rows, digests = pack_documents(docs).collect(), pack_digests(docs).collect()
    ends, order, fill = dict.fromkeys(texts, 0), sorted(rows, key=lambda r: (r.doc_id, r.start)), defaultdict(list)
    for r in order:
        assert r.start == ends[r.doc_id] and r.ids == whole[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(whole[r.doc_id])
        ends[r.doc_id] += r.length
        fill[r.sequence_id].append((r.offset, r.length))
    assert ends == {i: len(w) for i, w in whole.items()}
    for parts in fill.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1])
        n = sum(m for _, m in parts)
        assert n <= 4096 and (4096 - n <= 16 or n.bit_count() == 1)
    key = lambda r: (r.doc_id, r.start, r.length, r.sequence_id, r.offset, r.doc_tokens)
    crc = {key(r): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}
    assert {key(r): r.ids_crc32 for r in digests} == crc
    built = sequences(pack_documents(docs)).collect()
    assert len(built) == len(fill) and all(len(r.ids) in (4096, r.n_tokens) and (len(r.ids) == 4096 or r.n_tokens.bit_count() == 1) for r in built)
    assert sum(r.n_tokens for r in built) == sum(map(len, whole.values()))


def test_corners(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "x" * 50000)], "doc_id long, text string")
    clash = docs.selectExpr("*", "7 AS length", "7 AS ids", "7 AS task", "7 AS nth", "7 AS rank", "7 AS base", "7 AS count", "7 AS sequence_id")
    rows = lambda d: sorted(map(str, pack_digests(d).collect()))
    assert rows(clash) == rows(docs) and pack_digests(docs.where("false")).count() == 0
    assert sum(r.length == r.doc_tokens == 1 for r in pack_digests(docs).collect()) == 2
