"""Substring dedup judges windows by their words, not by the sketch's vectorised hashes."""

import pytest

from corrgrid.llm import substring_dedup as op
from corrgrid.llm.substring_dedup import substring_dedup, word_hashes


def thue_morse(n):
    flip = str.maketrans("ab", "ba")
    s = "a"
    while len(s) < n:
        s += s.translate(flip)
    return s, s.translate(flip)


def test_colliding_words_keep_their_windows(spark):
    a, b = thue_morse(2048)
    assert word_hashes(a.encode())[0] == word_hashes(b.encode())[0]
    tail = " ".join(f"t{i}" for i in range(12))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"x {a} {tail}")]
    got = {r.doc_id: r.n_removed for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


@pytest.mark.parametrize("limit", [0, 10**6])
def test_same_result_at_every_number_of_masks(spark, monkeypatch, limit):
    monkeypatch.setattr(op, "BROADCAST_IDS", limit)
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"own{i} {common} end{i}") for i in range(30)] + [(100 + i, f"plain {i} " * 20) for i in range(20)] + [(None, common)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), sketch_bits=8).collect()}
    assert len(got) == len(rows) and got[0] == (42, 0) and got[None] == (40, 40)
    assert all(got[i] == (42, 40) for i in range(1, 30)) and all(got[100 + i][1] == 0 for i in range(20))
