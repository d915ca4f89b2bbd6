"""The near-duplicate stage against plain Python on planted copies."""

import random

import pytest

import corpus_pipeline
from corrgrid.llm import near_copies


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def planted():
    rng = random.Random(7)
    common, rows = [f"c{i}" for i in range(60)], []
    for length, edits in [(100, 1), (200, 2), (200, 4), (400, 8), (800, 8), (100, 4)]:
        for _ in range(6):
            base = [f"w{rng.randrange(5000)}" for _ in range(length)]
            if length == 200:
                base[:60] = common  # a passage that unrelated documents share
            for _ in range(3):
                copy = list(base)
                for at in rng.sample(range(length), edits):
                    copy[at] = f"z{rng.randrange(10**6)}"
                rows.append((" ".join(base), " ".join(copy)))
    texts = list(dict.fromkeys(t for pair in rows for t in pair)) + ["a b", "A  b", "a b c", "", " "]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def groups(texts):
    sets, group = {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}
    edges = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    while any(group[a] != group[b] for a, b in edges):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    return group, len(edges)


@pytest.mark.parametrize("sampled", [1, 16])
def test_stage_keeps_one_of_each_similar_group(spark, monkeypatch, sampled):
    monkeypatch.setattr(near_copies, "SAMPLED", sampled)
    texts = planted()
    group, links = groups(texts)
    assert links > 60
    docs = spark.createDataFrame([*texts.items(), (None, "a b"), (None, None)], "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()]
    assert kept.count(None) == 2
    assert sorted(i for i in kept if i is not None) == [i for i in sorted(texts) if group[i] == i]
