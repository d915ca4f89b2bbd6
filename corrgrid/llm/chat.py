"""Chat formatting with tool-call linking.

Messages are parsed once, each on its own. Calls and results meet in a hash join on (conversation,
call id), calls and tool schemas on (conversation, tool name). Only messages that hold calls, results
or schemas take part; all others pass straight through, so a conversation of any length is never
gathered. Order is a key per message, (effective turn, level): a message whose needs come later
moves just behind them, until every call precedes its result and every result the calls that refer
to it. Only connected groups of messages with a link that leads backward are looked at: one task
orders the keys of a group up to ORDERED_AT_ONCE, larger ones are ordered by joins in rounds.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgrid.llm.common import discard, staged
from corrgrid.llm.components import components

#: An argument that refers to an earlier call's result.
REFERENCE = re.compile(r"\$\{([^}]+)\}")
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}
MESSAGE = "conv_id long, turn long, role string, rid long, json string, calls array<struct<idx:int,id:string,name:string,args:string,needs:array<string>>>, result_of string, tools array<struct<name:string,schema:string>>, malformed array<string>"
#: Tool messages that links join, up to which one task orders them from their keys; larger groups are ordered in rounds.
ORDERED_AT_ONCE = 100_000
#: Lists and objects inside each other at most; deeper JSON counts as text.
MOST_NESTED = 200


def _whole(x: float) -> int | float:
    return int(x) if math.isfinite(x) and x == int(x) else x


def settle(value: Any) -> Any:
    """One value for equal numbers: whole floats become integers, infinities and NaN null; lone surrogates become U+FFFD."""
    if isinstance(value, float):
        return _whole(value) if math.isfinite(value) else None
    if isinstance(value, str):
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, list):
        return [settle(x) for x in value]
    return {settle(k): settle(v) for k, v in value.items()} if isinstance(value, dict) else value


def read_json(text: str) -> Any:
    """The JSON value of a text; ValueError if it has none, or one nested deeper than MOST_NESTED."""
    try:
        value = json.loads(text)
    except RecursionError:
        raise ValueError("nested too deep") from None
    level = [value]
    for _ in range(MOST_NESTED):
        level = [x for v in level if isinstance(v, list | dict) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return settle(value)
    raise ValueError("nested too deep")


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spare white space; one text for one value."""
    return json.dumps(settle(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _same(a: Any, b: Any) -> bool:
    return canonical(a) == canonical(b)


def problems(value: Any, schema: Any, at: str = "$") -> list[str]:
    """Violations of a JSON Schema subset: type, enum, required, properties, additionalProperties, items, minimum, maximum.

    A keyword whose own value has the wrong form is reported and constrains nothing.
    """
    if schema is True or schema is None:
        return []
    if not isinstance(schema, dict):
        return [f"{at}: no such value" if schema is False else f"{at}: bad schema"]
    out = []

    def keyword(name: str, fits: Callable[[Any], bool]) -> Any:
        if name not in schema:
            return None
        if not fits(schema[name]):
            out.append(f"{at}: bad {name} in schema")
            return None
        return schema[name]

    strings = lambda x: isinstance(x, list) and all(isinstance(k, str) for k in x)
    kinds = keyword("type", lambda x: x in TYPES if isinstance(x, str) else strings(x) and all(k in TYPES for k in x))
    kinds = [kinds] if isinstance(kinds, str) else kinds
    fits = lambda k: isinstance(value, TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number"))
    if kinds and not any(fits(k) for k in kinds):
        return [*out, f"{at}: not of type {'|'.join(kinds)}"]
    enum = keyword("enum", lambda x: isinstance(x, list))
    if enum is not None and not any(_same(value, x) for x in enum):
        out.append(f"{at}: not in enum")
    known = keyword("properties", lambda x: isinstance(x, dict)) or {}
    required = keyword("required", strings) or []
    least, most = keyword("minimum", _number), keyword("maximum", _number)
    if isinstance(value, dict):
        out += [f"{at}.{k}: missing" for k in required if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                out += problems(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unexpected")
    elif isinstance(value, list) and "items" in schema:
        out += [p for i, v in enumerate(value) for p in problems(v, schema["items"], f"{at}[{i}]")]
    elif _number(value):
        out += [f"{at}: below minimum"] if least is not None and value < least else []
        out += [f"{at}: above maximum"] if most is not None and value > most else []
    return out


def _name(x: Any) -> str | None:
    """Ids and names as text; a value that is no text stands as its JSON."""
    return None if x is None else x if isinstance(x, str) else canonical(x)


def parse(role: str | None, text: str | None) -> dict[str, Any]:
    """A message's canonical JSON, calls, the call it answers, the tools it declares and what is malformed."""
    body = None
    if text and text.lstrip()[:1] == "{":
        try:
            body = read_json(text)
        except ValueError:
            body = None
    if not isinstance(body, dict) or not body.keys() & {"tool_calls", "tool_call_id", "tools"}:
        return {"json": canonical({"content": text, "role": role}), "calls": [], "result_of": None, "tools": [], "malformed": []}
    calls, tools, bad = [], [], []

    def entries(key: str) -> Iterator[tuple[dict, dict]]:
        """Entries of a list of calls or tools: the entry and its function."""
        found = body.get(key)
        if found is not None and not isinstance(found, list):
            bad.append(f"{key}: not a list")
        for i, raw in enumerate(found if isinstance(found, list) else []):
            own = raw.get("function", raw) if isinstance(raw, dict) else None
            if not isinstance(own, dict):
                bad.append(f"{key}[{i}]: not an object")
            yield raw if isinstance(raw, dict) else {}, own if isinstance(own, dict) else {}

    for raw, call in entries("tool_calls"):
        args = call.get("arguments")
        if isinstance(args, str):
            try:
                args = read_json(args)
            except ValueError:
                pass  # kept as text; a schema of type object will not accept it
        shown = canonical(args)
        calls.append({"idx": len(calls), "id": _name(raw.get("id")), "name": _name(call.get("name")), "args": shown, "needs": sorted(set(REFERENCE.findall(shown)))})
    for _, tool in entries("tools"):
        if tool.get("name") is not None:
            tools.append({"name": _name(tool["name"]), "schema": canonical(tool.get("parameters", {}))})
    out = {k: v for k, v in body.items() if k not in ("tool_calls", "tools")} | {"role": role}
    if calls:
        out["tool_calls"] = [{"arguments": json.loads(c["args"]), "id": c["id"], "name": c["name"]} for c in calls]
    if tools:
        out["tools"] = [{"name": t["name"], "parameters": json.loads(t["schema"])} for t in tools]
    return {"json": canonical(out), "calls": calls, "result_of": _name(body.get("tool_call_id")), "tools": tools, "malformed": bad}


def _parse_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("json", pa.string()), ("calls", pa.list_(pa.struct([("idx", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("args", pa.string()), ("needs", pa.list_(pa.string()))]))), ("result_of", pa.string()), ("tools", pa.list_(pa.struct([("name", pa.string()), ("schema", pa.string())]))), ("malformed", pa.list_(pa.string()))])
    for batch in batches:
        parsed = [parse(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        made = pa.RecordBatch.from_pylist(parsed, schema=kinds)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role", "rid")), *made.columns], ["conv_id", "turn", "role", "rid", *kinds.names])


def _validate_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [problems(json.loads(a), json.loads(s)) if s is not None else ["no schema"] for a, s in zip(batch.column("args").to_pylist(), batch.column("schema").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("idx"), pa.array(found, pa.list_(pa.string()))], ["rid", "idx", "errors"])


def _ordered(turns: dict[int, int], edges: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """(effective turn, level) of the messages of one component, so that kept links lead to greater keys.

    Links of messages that lie on cycles, or between two cycles, are kept only if they lead forward.
    """
    after: dict[int, list[int]] = {}
    before: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)

    def peel(nodes: set[int], into: dict[int, list[int]], out: dict[int, list[int]]) -> set[int]:
        left = {v: sum(w in nodes for w in into.get(v, ())) for v in nodes}
        free, core = [v for v in nodes if not left[v]], set(nodes)
        while free:
            v = free.pop()
            core.discard(v)
            for w in out.get(v, ()):
                if w in nodes:
                    left[w] -= 1
                    if not left[w]:
                        free.append(w)
        return core

    core = peel(peel(set(turns), before, after), after, before)
    kept = [(a, b) for a, b in edges if not (a in core and b in core) or (turns[a], a) < (turns[b], b)]
    out: dict[int, list[int]] = {}
    need = dict.fromkeys(turns, 0)
    for a, b in kept:
        out.setdefault(a, []).append(b)
        need[b] += 1
    key = {v: (t, 0) for v, t in turns.items()}
    free = [v for v in turns if not need[v]]
    while free:
        v = free.pop()
        for w in out.get(v, ()):
            if key[w] <= key[v]:
                key[w] = (key[v][0], key[v][1] + 1)
            need[w] -= 1
            if not need[w]:
                free.append(w)
    return key


def _order_task(table: pa.Table) -> pa.Table:
    rids, turns = table["rid"].to_pylist(), table["turn"].to_pylist()
    key = _ordered(dict(zip(rids, turns, strict=True)), [(a, b) for b, into in zip(rids, table["into"].to_pylist(), strict=True) for a in into])
    return pa.table([pa.array(rids, pa.int64()), pa.array([key[v][0] for v in rids], pa.int64()), pa.array([key[v][1] for v in rids], pa.int32())], ["rid", "eff_turn", "level"])


def _order_in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """_ordered for components too large for one task: each step of it is a join, as often as the longest chain has links."""

    def peel(nodes: DataFrame, into: str, out: str) -> DataFrame:
        size = nodes.count()
        while True:
            inner = edges.join(nodes.withColumnRenamed("rid", into), into, "left_semi").join(nodes.withColumnRenamed("rid", out), out, "left_semi")
            last, nodes = nodes, staged(inner.select(F.col(out).alias("rid")).distinct())
            discard(last)
            if (now := nodes.count()) == size:
                return nodes
            size = now

    core = peel(peel(staged(nodes.select("rid")), "src", "dst"), "dst", "src").select("rid", F.lit(True).alias("core"))
    a, b = nodes.join(core, "rid", "left").select(F.col("rid").alias("src"), F.col("turn").alias("ta"), F.col("core").alias("ca")), nodes.join(core, "rid", "left").select(F.col("rid").alias("dst"), F.col("turn").alias("tb"), F.col("core").alias("cb"))
    forward = F.struct(F.col("ta"), F.col("src")) < F.struct(F.col("tb"), F.col("dst"))
    kept = staged(edges.join(a, "src").join(b, "dst").where(F.col("ca").isNull() | F.col("cb").isNull() | forward).select("src", "dst"))
    now = staged(nodes.select("rid", F.col("turn").alias("eff_turn"), F.lit(0).alias("level")))
    while True:
        a, b = now.select(F.col("rid").alias("src"), F.struct("eff_turn", "level").alias("ka")), now.select(F.col("rid").alias("dst"), F.struct("eff_turn", "level").alias("kb"))
        late = staged(kept.join(a, "src").join(b, "dst").where(F.col("kb") <= F.col("ka")).groupBy("dst").agg(F.max("ka").alias("after")))
        if late.isEmpty():
            return now
        moved = now.join(late, now.rid == late.dst, "left").select("rid", F.coalesce("after.eff_turn", "eff_turn").alias("eff_turn"), F.coalesce(F.col("after.level") + 1, F.col("level")).alias("level"))
        last, now = now, staged(moved)
        discard(last)
        discard(late)


def _order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rid, eff_turn, level of messages (rid, turn). Only components of links with one that leads backward need any work."""
    edges = staged(edges.distinct())
    a, b = nodes.select(F.col("rid").alias("src"), F.col("turn").alias("ta")), nodes.select(F.col("rid").alias("dst"), F.col("turn").alias("tb"))
    still = nodes.select("rid", F.col("turn").alias("eff_turn"), F.lit(0).alias("level"))
    late = staged(edges.join(a, "src").join(b, "dst").where("tb <= ta").select("src", "dst"))
    if late.isEmpty():
        return still
    found = staged(components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))))
    group = lambda rid: found.select(F.col("node").alias(rid), F.col("component").alias("grp"))
    touched = late.join(group("dst"), "dst", "left").select(F.coalesce("grp", "dst").alias("grp")).distinct()
    moving = nodes.join(group("rid"), "rid", "left").withColumn("grp", F.coalesce("grp", "rid")).join(touched, "grp", "left_semi")
    into = edges.groupBy(F.col("dst").alias("rid")).agg(F.collect_list("src").alias("into"))
    moving = moving.join(into, "rid", "left").select("rid", "turn", "grp", F.coalesce("into", F.array().cast("array<long>")).alias("into"))
    sized = staged(moving.join(moving.groupBy("grp").agg(F.sum(F.size("into") + 1).alias("weight")), "grp"))
    small = sized.where(F.col("weight") <= ORDERED_AT_ONCE).groupBy("grp").applyInArrow(_order_task, "rid long, eff_turn long, level int")
    large = sized.where(F.col("weight") > ORDERED_AT_ONCE)
    if not large.isEmpty():
        small = small.unionByName(_order_in_rounds(large.select("rid", "turn"), large.select(F.explode("into").alias("src"), F.col("rid").alias("dst"))))
    small = staged(small)
    return still.join(small, "rid", "left_anti").unionByName(small)


def link_tools(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, eff_turn, level, n_calls, n_linked, n_orphans, n_invalid, errors, json.

    A message whose text is a JSON object with tool_calls, tool_call_id or tools takes part in the
    linking; every other text is plain content, null content stays null. Sorting by conv_id, eff_turn,
    level, turn gives a topological order. n_linked counts calls with a result, n_orphans is 1 for a
    result without a call, n_invalid counts calls whose arguments break the schema or that name no
    declared tool. JSON nested deeper than 200 levels is text, as a message and as arguments. Of calls with one id the first (turn, position) is linked; repeated results all
    are. Null conv_ids, ids and names match nothing. Messages on cycles of references, or between two
    cycles, keep only the links that lead forward. Calls, tools and schemas of a wrong form are named
    in errors; numbers of one value have one text, and infinities become null. Repeated rows are
    separate messages; texts of any length are parsed each on its own. Empty tables give no rows;
    further columns are ignored.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.monotonically_increasing_id().alias("rid"))
    rows = staged(rows.mapInArrow(_parse_task, MESSAGE))
    special = (F.size("calls") > 0) | F.col("result_of").isNotNull() | (F.size("tools") > 0) | (F.size("malformed") > 0)
    none = F.array().cast("array<string>")
    simple = rows.where(~special).select("conv_id", "turn", "role", F.col("turn").alias("eff_turn"), F.lit(0).alias("level"), *[F.lit(0).alias(c) for c in ("n_calls", "n_linked", "n_orphans", "n_invalid")], none.alias("errors"), "json")
    tool = rows.where(special)
    if tool.isEmpty():
        return simple
    calls = tool.select("conv_id", "turn", "rid", F.inline("calls"))
    first = calls.where("conv_id is not null and id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "rid", "idx")).alias("c")).select("conv_id", "id", F.col("c.rid").alias("call_rid"), F.col("c.idx").alias("call_idx"))
    first = staged(first)
    results = tool.where("result_of is not null").select("conv_id", F.col("result_of").alias("id"), "rid")
    answered = staged(results.join(first, ["conv_id", "id"], "left"))
    schemas = tool.select("conv_id", "turn", "rid", F.inline("tools")).groupBy("conv_id", "name").agg(F.min(F.struct("turn", "rid", "schema"))["schema"].alias("schema"))
    checked = calls.join(schemas, ["conv_id", "name"], "left").select("rid", "idx", "args", "schema").mapInArrow(_validate_task, "rid long, idx int, errors array<string>")
    per_call = checked.groupBy("rid").agg(F.count(F.lit(1)).alias("n_calls"), F.sum((F.size("errors") > 0).cast("int")).alias("n_invalid"), F.array_sort(F.collect_list(F.struct("idx", "errors"))).alias("e"))
    per_call = per_call.select("rid", "n_calls", "n_invalid", F.flatten(F.transform("e", lambda x: F.transform(x["errors"], lambda m: F.concat(x["idx"].cast("string"), F.lit(" "), m)))).alias("errors"))
    linked = answered.where("call_rid is not null").groupBy(F.col("call_rid").alias("rid")).agg(F.countDistinct("call_idx").alias("n_linked"))
    orphans = answered.groupBy("rid").agg(F.sum(F.col("call_rid").isNull().cast("int")).alias("n_orphans"))
    edges = answered.where("call_rid is not null").select(F.col("call_rid").alias("src"), F.col("rid").alias("dst"))
    needs = calls.select("conv_id", F.col("rid").alias("dst"), F.explode("needs").alias("id")).join(answered.select("conv_id", "id", F.col("rid").alias("src")), ["conv_id", "id"]).select("src", "dst")
    order = _order(tool.select("rid", "turn").withColumn("turn", F.coalesce("turn", F.lit(0))), edges.unionByName(needs).where("src <> dst"))
    full = tool.join(per_call, "rid", "left").join(linked, "rid", "left").join(orphans, "rid", "left").join(order, "rid")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    return simple.unionByName(full.select("conv_id", "turn", "role", "eff_turn", "level", count("n_calls"), count("n_linked"), count("n_orphans"), count("n_invalid"), F.concat("malformed", F.coalesce("errors", none)).alias("errors"), "json"))
