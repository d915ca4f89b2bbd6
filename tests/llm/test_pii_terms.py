"""Disclosing terms of rare entities, at any distance and in every document."""

import math
import random
import re

from corrgrid.llm.pii import find_pii


def test_rare_far_and_distant_terms(spark):
    far = "filler words " * 40
    rows = [(1, f"zebulon {far}mail zeb@x.example.com"), (2, "about zebulon only"), (3, "q.r@y.example.org " + far[:73] + " xylophonist")]
    rows += [(100 + i, f"mail about filler words only {i}") for i in range(5000)]
    got = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.85).collect()}
    assert got[1].startswith("term:0:7,email:") and got[2] == "term:6:13" and got[100] == ""
    assert got[3].split(",")[1:] == ["term:92:103"]


def test_terms_against_plain_python(spark):
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(400)]
    people = [f"p{i}@example{i % 7}.org" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 20 if rng.random() < 0.7 else 400]) for _ in range(12)) + "".join(f" {rng.choice(people)} nation" for _ in range(rng.randrange(3)) if i % 9 == 0)) for i in range(1500)]
    rows += [(2000, "examination " + " " * 62 + people[0]), (2001, "nation " + " ".join(people[:30]))]
    email, word, n = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), re.compile(r"[^\W_]+"), len(rows)
    held = {i: {m.lower() for m in email.findall(t)} for i, t in rows}
    terms = {i: {w.lower() for w in word.findall(t) if len(w) >= 3} for i, t in rows}
    count, both = {}, {}
    for i, _ in rows:
        for x in [*held[i], *terms[i]]:
            count[x] = count.get(x, 0) + 1
        for e in held[i]:
            for t in terms[i]:
                both[e, t] = both.get((e, t), 0) + 1
    strong = {t for (e, t), k in both.items() if math.log2(k / (count[t] + 1) * n / count[e]) / math.log2(n / count[e]) >= 0.7}
    assert 5 < len(strong) < 400
    got = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.7).collect()}
    for i, t in rows:
        spans = [m.span() for m in email.finditer(t)]
        want = [f"term:{m.start()}:{m.end()}" for m in word.finditer(t) if m[0].lower() in strong and not any(a < m.end() and m.start() < b for a, b in spans)]
        assert [x for x in got[i].split(",") if x.startswith("term")] == want, i
