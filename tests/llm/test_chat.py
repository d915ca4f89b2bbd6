"""Tool-call linking: malformed messages, cycles, and a plain Python linker on many conversations."""

import json
import random

import pytest

from corrgrid.llm import chat
from corrgrid.llm.chat import canonical, link_tools, parse, problems

SCHEMA = "conv_id long, turn long, role string, text string"
BAD = [
    '{"tool_calls":{"a":1}}', '{"tool_calls":7}', '{"tools":"x"}', '{"tool_calls":[{"function":null}]}', '{"tool_calls":[{"function":"f"}]}', '{"tool_calls":[null,3]}',
    '{"tool_calls":[{"id":5,"name":7,"arguments":{"a":"\\ud800"}}]}', '{"tool_call_id":{"x":1},"content":"\\udc00"}', '{"tools":[{"name":["f"],"parameters":3}]}',
    '{"tool_calls":[{"id":"z","name":"f","arguments":"{\\"n\\":1e999}"}]}', '{"tool_calls":' + "[" * 3000 + "]" * 3000 + "}", '{"tool_call_id":null,"tools":[{"name":"f","parameters":{"type":5}}]}',
]


def test_malformed_messages_get_rows(spark):
    rows = [(1, i, "assistant", t) for i, t in enumerate(BAD)] + [(1, 100, "assistant", '{"tool_calls":[{"id":"q","name":"f","arguments":{}}]}')]
    got = {r.turn: r for r in link_tools(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert all("Infinity" not in r.json and json.loads(r.json) is not None for r in got.values())
    assert got[0].errors == ["tool_calls: not a list"] and got[3].errors[0] == "tool_calls[0]: not an object" and got[100].errors == ["0 $: bad type in schema"]
    assert got[6].json == '{"role":"assistant","tool_calls":[{"arguments":{"a":"�"},"id":"5","name":"7"}]}'


def test_one_text_for_one_value():
    assert canonical({"b": 1.0, "a": [2e0, 0.5, float("inf")]}) == '{"a":[2,0.5,null],"b":1}'
    assert problems(parse("a", '{"tool_calls":[{"arguments":{"n":1.0}}]}') and 1, {"type": "integer"}) == []
    for schema in ({"type": 5}, {"properties": None}, {"required": 3}, {"minimum": "x"}, {"enum": 3}, 7):
        assert len(problems({"a": 1}, schema)) == 1
    assert problems(True, {"enum": [1]}) and not problems(1, {"enum": [1.0]}) and problems(1, False)


@pytest.mark.parametrize("bound", [0, 10**5])
def test_cycles_and_chains(spark, monkeypatch, bound):
    monkeypatch.setattr(chat, "ORDERED_AT_ONCE", bound)
    call = lambda i, needs: json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": needs}]})
    answer = lambda i: json.dumps({"tool_call_id": i})
    rows = [(1, 0, "a", call("a", "${b}")), (1, 1, "t", answer("a")), (1, 2, "a", call("b", "${a}")), (1, 3, "t", answer("b")), (1, 4, "a", call("c", "${a}")), (1, 5, "t", answer("c"))]
    rows += [(1, 10 + i, "t", answer(f"n{i}")) for i in range(40)]
    rows += [(2, 9 - k, r, t) for k, (r, t) in enumerate([("a", call("x", "")), ("t", answer("x")), ("a", call("y", "${x}")), ("t", answer("y"))])]
    got = {(r.conv_id, r.turn): (r.eff_turn, r.level) for r in link_tools(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[1, t] for t in range(6)] == [(t, 0) for t in range(6)]
    assert [got[2, t] for t in (9, 8, 7, 6)] == [(9, 0), (9, 1), (9, 2), (9, 3)]


def test_many_conversations_against_plain_python(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for conv in range(4000):
        ids = [f"k{i}" for i in range(rng.randrange(0, 6))]
        messages = [("s", {"tools": [{"name": "f", "parameters": {"type": "object", "required": ["n"]}}]})] if rng.random() < 0.7 else []
        for k, i in enumerate(ids):
            args = {"n": k} if rng.random() < 0.8 else {}
            if k and rng.random() < 0.4:
                args["from"] = "${%s}" % rng.choice(ids[:k])
            messages += [("a", {"tool_calls": [{"id": i, "name": rng.choice("ffg"), "arguments": args}]}), ("t", {"tool_call_id": i if rng.random() < 0.9 else "none"})]
        rng.shuffle(messages)
        declared = any("tools" in m for _, m in messages)
        place = {m["tool_calls"][0]["id"]: t for t, (_, m) in enumerate(messages) if "tool_calls" in m}
        answers: dict[str, list[int]] = {}
        for t, (_, m) in enumerate(messages):
            answers.setdefault(m.get("tool_call_id"), []).append(t)
        key = {}

        def rank(t):
            if t not in key:
                m = messages[t][1]
                before = [place[m["tool_call_id"]]] if m.get("tool_call_id") in place else []
                if "tool_calls" in m:
                    need = m["tool_calls"][0]["arguments"].get("from", "")[2:-1]
                    before += answers.get(need, []) if need in place else []
                after = max((rank(x) for x in before), default=(-1, 0))
                key[t] = (after[0], after[1] + 1) if after >= (t, 0) else (t, 0)
            return key[t]

        for t, (role, m) in enumerate(messages):
            rows.append((conv, t, role, json.dumps(m)))
            c = m.get("tool_calls", [None])[0]
            bad = c is not None and (not declared or c["name"] != "f" or "n" not in c["arguments"])
            want[conv, t] = (*rank(t), int(c is not None), int(c is not None and c["id"] in answers), int(m.get("tool_call_id", "k") not in place and "tool_call_id" in m), int(bad))
    got = {(r.conv_id, r.turn): (r.eff_turn, r.level, r.n_calls, r.n_linked, r.n_orphans, r.n_invalid) for r in link_tools(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()}
    assert got == want


def test_nesting_at_every_depth(spark):
    depths = [1, 150, 199, 200, 201, *range(900, 1101, 5), 10_000]
    nested = lambda n: "[" * n + "]" * n
    rows = [(1, n, "assistant", json.dumps({"tool_calls": [{"id": f"c{n}", "name": "f", "arguments": nested(n)}]})) for n in depths]
    rows += [(2, n, "assistant", '{"tool_calls":[{"id":"c","name":"f","arguments":' + nested(n) + "}]}") for n in depths]
    rows += [(3, 0, "system", '{"tools":[{"name":"f","parameters":{"enum":[' + nested(190) + "]}}]}"), (3, 1, "assistant", '{"tool_calls":[{"id":"c","name":"f","arguments":' + nested(190) + "}]}")]
    got = {(r.conv_id, r.turn): r for r in link_tools(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for n in depths:
        assert got[1, n].n_calls == 1 and ('"arguments":"[' in got[1, n].json) == (n > 200)
    assert [got[2, n].n_calls for n in (1, 150, 201, 10_000)] == [1, 1, 0, 0] and got[3, 1].n_invalid == 0
