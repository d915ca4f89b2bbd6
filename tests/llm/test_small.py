"""Corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corrgrid.llm.bpe import codec, default_vocabulary, encode_digests, encode_documents
from corrgrid.llm.chat import link_tools
from corrgrid.llm.exact_dedup import exact_dedup, flush_runs, keep_first, probe
from corrgrid.llm.mixing import entropy_mix, repeat_copies
from corrgrid.llm.pii import find_pii
from corrgrid.llm.secrets import secrets
from corrgrid.llm.simhash import allocate, near_dedup
from corrgrid.llm.substring_dedup import substring_dedup
from corrgrid.llm.topk import top_k
from corrgrid.llm.toxicity import restore, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind string, start int, rid long, digest string, key string"
LONG = " ".join(f"w{i % 700}" for i in range(20000))
ROWS = [
    (1, "alpha  beta\tgamma"), (2, "alpha beta gamma"), (2, "alpha beta gamma"), (3, None), (4, ""), (5, LONG), (6, LONG + " tail"), (7, "x" * 60000),
    (None, "alpha beta gamma"), (9, "mail a.b@c.example.com or 10.0.0.1 é😀 +1 (555) 123-4567 password=abcdefgh12"), (10, " \n\t "),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en", None if i == 3 else f"s{(i or 0) % 3}", 1, "k", 1, 1, "d", "k") for i, t in rows], SCHEMA)


OPERATORS = {
    "exact": exact_dedup, "mix": entropy_mix, "pii": find_pii, "secrets": secrets, "simhash": near_dedup, "substring": substring_dedup, "bpe": encode_digests,
    "toxicity": lambda d: toxicity(d, d.sparkSession.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row_and_none_for_none(spark, name):
    assert OPERATORS[name](docs(spark)).count() == len(ROWS)
    assert OPERATORS[name](docs(spark).where("false")).count() == 0


def test_exact_groups(spark):
    got = [tuple(r) for r in exact_dedup(docs(spark)).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert (1, 1, 4, True) in got and got.count((2, 1, 4, False)) == 2 and (None, 1, 4, False) in got
    assert (3, 3, 2, True) in got and (4, 3, 2, False) in got
    assert keep_first(docs(spark)).count() == len(ROWS) - 4


def test_exact_survives_digest_collisions(spark):
    weak = lambda x: F.unhex(F.lpad((F.length(x) % 2).cast("string"), 2, "0"))
    strong = sorted(map(str, exact_dedup(docs(spark)).collect()))
    assert sorted(map(str, exact_dedup(docs(spark), digest=weak).collect())) == strong


def test_exact_probe(spark):
    runs = flush_runs(docs(spark))
    assert probe(runs, [hashlib.sha256(b"alpha beta gamma").digest()]).count() == 4


def test_mix_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50))) for i in range(600)]
    got = entropy_mix(docs(spark, rows)).toPandas()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert by.target.sum() == pytest.approx(1.5 * got["size"].sum())
    assert ((by.target - by.taken).abs() <= 3).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    assert (got.taken <= 2 * got["size"]).all()
    again = entropy_mix(docs(spark, rows).repartition(3)).toPandas()
    assert sorted(map(tuple, got[["doc_id", "taken"]].values)) == sorted(map(tuple, again[["doc_id", "taken"]].values))
    assert repeat_copies(docs(spark, rows)).count() == got.copies.sum()


def test_base_spans(spark):
    p = {r.doc_id: r for r in find_pii(docs(spark), with_text=True).collect()}
    assert p[9].spans == "email:5:22,ip:26:34,phone:38:55"
    assert p[9].sanitised.startswith("mail <EMAIL> or <IP> é😀 <PHONE> ")
    s = {r.doc_id: r for r in secrets(docs(spark)).collect()}
    assert s[9].spans == "assign:56:75" and s[9].found == ["password=abcdefgh12"[:19]]


def test_terms_that_disclose(spark):
    rows = [(i, f"zebulon wrote from zeb@x.example.com again {i}") for i in range(5)] + [(100 + i, f"plain words again {i}") for i in range(60)]
    got = {r.doc_id: r.spans for r in find_pii(docs(spark, rows)).collect()}
    assert "term:0:7" in got[0] and got[100] == ""


def test_weak_parts_need_each_other(spark):
    rows = [(1, "user=bob pass=hunter22 at https://x.y/z"), (2, "user=bob only"), (3, "user=bob " + "x " * 300 + "pass=hunter22")]
    got = {r.doc_id: r.spans for r in secrets(docs(spark, rows)).collect()}
    assert got == {1: "id:0:8,secret:9:22,endpoint:26:39", 2: "", 3: ""}


def test_simhash_links(spark):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in near_dedup(docs(spark)).collect()}
    by = {i: c for (i, _), c in got.items()}
    assert by[1] == by[2] == by[None] == 1 and by[3] == by[4] == by[10] == 3
    assert {f for (i, f) in got if i in (3, 4, 10)} == {"0" * 16}


@pytest.mark.parametrize("n", [10, 10**12])
def test_thresholds_cover_the_radius(n):
    plan = allocate([i * 0x9E3779B97F4A7C15 % 2**63 for i in range(200)], n, 2)
    assert sum(t + 1 for _, t in plan) == 3 and len({b for bits, _ in plan for b in bits}) == sum(len(bits) for bits, _ in plan)


def test_substring_by_hand(spark):
    common = " ".join(f"c{i}" for i in range(15))
    rows = [(1, "a " + common), (2, common + " b"), (2, common + " b"), (None, common), (5, " ".join(f"c{i}" for i in range(12)))]
    got = sorted((r.doc_id or 99, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs(spark, rows), with_text=True).collect())
    assert got == [(1, 16, 0, "a " + common), (2, 16, 15, "b"), (2, 16, 15, "b"), (5, 12, 0, " ".join(f"c{i}" for i in range(12))), (99, 15, 15, "")]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(default_vocabulary())
    texts = [t or "" for _, t in ROWS] + ["a<|endoftext|>b", "it's  we'LL\n\n x", "日本語 ՘ 🎉!!", "՘x \x85\x1c"]
    got = {r.doc_id: r for r in encode_documents(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == lib.encode(t, add_special_tokens=False).ids and got[i].decoded == t


def test_every_token_is_its_own_encoding():
    c = codec(default_vocabulary())
    assert all(c.merge_exactly(c.bytes_of[i]) == [i] for i in range(0, 50256, 97))


def test_topk_against_brute_force(spark):
    rows = [(i, [((i * 37 + j * 11) % 64 - 32) / 16 for j in range(8)]) for i in range(0, 400)] + [(400, None), (500, [1.0, None]), (600, [float("nan")]), (None, [1.0]), (100, [0.0] * 8), (700, [])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)), candidates=64, queries=2).collect()
    usable = [(i, [int(1024 * x // 1) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and x == x for x in v)]
    want = []
    for at, (i, v) in enumerate(usable):
        if i % 100 == 0:
            s = sorted((-sum(x * y for x, y in zip(v, w)), j) for other, (j, w) in enumerate(usable) if other != at)[:10]
            want += [(i, k + 1, j, -a) for k, (a, j) in enumerate(s)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_deobfuscation_restores_words():
    import numpy as np

    lm = np.zeros((28, 28, 28)).tolist()
    for w in ("idiot", "stupid"):
        a = b = 0
        for c in [ord(x) - 96 for x in w] + [0]:
            lm[a][b][c] = 2.0
            a, b = b, c
    assert [restore(w, lm) for w in ("1d10t", "i.d.i.o.t", "stuuupid", "hello", "4242")] == ["idiot", "idiot", "stupid", "hello", "4242"]


def test_toxicity_learns_from_labels_alone(spark):
    rows = [(i, ("the mean grobnik said so " if i % 4 == 0 else "the kind fellow said so ") + f"n{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = toxicity(docs(spark, rows + [(1001, "the m3an gr0bnik said so"), (1002, "")]), labels).toPandas().set_index("doc_id")
    held = got[got.held_out & (got.index < 400)]
    assert len(held) > 40 and ((held.predicted == 1) == (held.index % 4 == 0)).mean() > 0.95
    assert got.loc[1001].predicted == 1 and got.loc[1002].predicted == 0


CHAT = [
    (1, 0, "system", '{"tools":[{"name":"add","parameters":{"type":"object","required":["a"],"properties":{"a":{"type":"integer"}},"additionalProperties":false}}]}'),
    (1, 1, "tool", '{"tool_call_id":"c1","content":"3"}'),
    (1, 2, "assistant", '{"content":null,"tool_calls":[{"id":"c1","name":"add","arguments":"{\\"a\\": 1}"},{"id":"c2","function":{"name":"add","arguments":{"b":2}}}]}'),
    (1, 3, "assistant", '{"tool_calls":[{"id":"c3","name":"add","arguments":{"a":"${c2}"}}]}'), (1, 4, "tool", '{"tool_call_id":"c2","content":"4"}'),
    (1, 5, "tool", '{"tool_call_id":"nope","content":"4"}'), (1, 6, "user", "{broken"), (None, None, None, None), (2, 0, "tool", '{"tool_call_id":"c1"}'),
]


def test_tool_linking(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("rid", F.lit(1)).withColumn("id", F.lit("x"))
    got = {(r.conv_id, r.turn): r for r in link_tools(df).collect()}
    assert len(got) == len(CHAT)
    key = lambda t: (got[1, t].eff_turn, got[1, t].level, t)
    assert key(2) < key(1) and key(4) < key(3) and key(2) < key(4)
    call = got[1, 2]
    assert (call.n_calls, call.n_linked, call.n_invalid) == (2, 2, 1) and call.errors == ["1 $.a: missing", "1 $.b: unexpected"]
    assert got[1, 5].n_orphans == 1 and got[2, 0].n_orphans == 1
    assert call.json.startswith('{"content":null,"role":"assistant","tool_calls":[{"arguments":{"a":1},"id":"c1"')
    assert got[1, 6].json == '{"content":"{broken","role":"user"}' and got[None, None].json == '{"content":null,"role":null}'


def test_tool_cycles_end(spark):
    rows = [(1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":"${b}"}]}'), (1, 1, "tool", '{"tool_call_id":"a"}'), (1, 2, "assistant", '{"tool_calls":[{"id":"b","name":"f","arguments":"${a}"}]}'), (1, 3, "tool", '{"tool_call_id":"b"}')]
    assert link_tools(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == 4


def test_pipeline_stages(spark):
    import corpus_pipeline
    from corrgrid.llm.common import staged, table

    d = "/root/testdata/sf0.001"
    before = table(spark, d, "documents")
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, before, d))
        a, b = [x.toPandas() for x in (before, after)]
        if name != "bpe":
            assert after.columns == before.columns and set(b.doc_id) <= set(a.doc_id)
        if name == "exact_dedup":
            flat = [re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in a.text]
            first: dict[str, int] = {}
            for i, t in sorted(zip(a.doc_id, flat, strict=True)):
                first.setdefault(t, i)
            assert sorted(b.doc_id) == sorted(first.values())
        if name == "bpe":
            assert len(a) == len(b)
            want = {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(a.doc_id, a.text, strict=True)}
            assert want == set(zip(b.doc_id, b.decoded_sha256, strict=True))
        before = after


def test_parts_link_by_the_gap_between_them(spark):
    """Against plain Python: a weak part is reported if a part of another role begins or ends within 200 code points of it."""
    import random
    import re

    from corrgrid.llm import secrets as S

    rng = random.Random(4)
    texts = ["auth=" + "x" * 300 + " user=bob1", "f" * 250 + " " + "u" * 0 + "user=bob1", "auth=" + "y" * 5000 + " user=eve2", "user=far1 " + "-" * 190 + " pin=123456", "user=far1 " + "-" * 250 + " pin=123456"]
    words = ["user=bob{}", "login: amy{}", "pin=12345{}", "auth=zzzz{}" + "z" * 260, "https://h{}.org/x", "password=abcdefgh{}", "AKIA0123456789ABCDE{}", "word" * 12, "w " * 60, "d" * 240]
    texts += [" ".join(rng.choice(words).replace("{}", str(rng.randrange(9))) for _ in range(25)) for _ in range(60)]
    patterns = {"assign": (S.ASSIGN, 2, lambda m: len(m[2]) >= 8), "access": (S.ACCESS, 0, lambda m: len(m[0]) >= 16), "hex": (S.HEX, 0, lambda m: True), "id": (S.WEAK_ID, 1, None), "secret": (S.WEAK_SECRET, 1, None), "endpoint": (S.ENDPOINT, 1, None)}
    role = {"assign": "secret", "access": "id", "hex": "secret"}
    got = {r.doc_id: r.spans for r in secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    linked = 0
    for i, t in enumerate(texts):
        parts = [(k, *m.span()) for k, (p, _, ok) in patterns.items() for m in re.finditer(p, t, re.A) if ok is None or ok(m)]
        kept = [(k, a, b) for k, a, b in parts if k in role or any(role.get(k2, k2) != k and a2 <= b + 200 and b2 >= a - 200 for k2, a2, b2 in parts)]
        linked += sum(k not in role for k, _, _ in kept)
        order = list(patterns)
        assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(kept, key=lambda x: (x[1], order.index(x[0]), x[2]))), t
    assert linked > 100 and "id:" in got[0] and "id:" in got[1] and "id:" in got[2] and "id:" in got[3] and "id:" not in got[4]
