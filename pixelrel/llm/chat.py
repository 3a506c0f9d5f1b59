"""Linking tool calls to their results in conversations, and canonical serialisation."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: Tool name -> schema of its arguments: type, properties, required, items and enum are checked, at any depth.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}
PYTHON = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
PARSED = "calls array<struct<id:string,name:string,args:string,deps:array<string>>>, unlinkable int, result_id string, body string"
SURROGATE = re.compile("[\ud800-\udfff]")
#: Conversations with up to this many dependencies are ordered in one task each; larger ones level by level.
IN_ONE_TASK = 100_000


def _plain(text: str) -> str:
    """``text`` with lone surrogates, which UTF-8 cannot hold, as escapes."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return _plain(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _call(c: dict) -> dict | None:
    """One call; {"id", "function": {"name", "arguments"}} and arguments given as a JSON string are read alike. None without an id."""
    if c.get("id") is None:
        return None
    inner = c["function"] if isinstance(c.get("function"), dict) else c
    args, deps = inner.get("arguments"), c.get("depends_on")
    if isinstance(args, str):
        try:
            args = json.loads(args)
            canonical(args)
        except (ValueError, RecursionError):
            args = inner["arguments"]
    return {"id": _plain(str(c["id"])), "name": _plain(str(inner.get("name") or "")), "args": canonical(args), "deps": [_plain(str(x)) for x in deps] if isinstance(deps, list) else []}


def parse(text: str | None) -> dict:
    """Calls ({"tool_calls": [{"id", "name", "arguments", "depends_on"}]}) or a result ({"tool_call_id", "content"}); else plain text.

    Text that is no JSON, or holds numbers beyond double precision, is plain. Calls without an id cannot be linked and are counted.
    """
    plain = {"calls": [], "unlinkable": 0, "result_id": None, "body": text or ""}
    if not text or not text.lstrip().startswith("{"):
        return plain
    try:
        data = json.loads(text)
        given = [c for c in data["tool_calls"] if isinstance(c, dict)] if isinstance(data.get("tool_calls"), list) else []
        calls = [_call(c) for c in given]
        result = None if data.get("tool_call_id") is None else _plain(str(data["tool_call_id"]))
        if not given and result is None:
            return plain
        return {"calls": [c for c in calls if c], "unlinkable": calls.count(None), "result_id": result, "body": canonical(data)}
    except (ValueError, RecursionError):
        return plain


def valid(data, schema: Mapping) -> bool:
    """Whether ``data`` fits ``schema``; an object may hold no other properties than those named."""
    kind = schema.get("type")
    if kind and (not isinstance(data, PYTHON[kind]) or (isinstance(data, bool) and kind in ("integer", "number"))):
        return False
    if "enum" in schema and data not in schema["enum"]:
        return False
    if isinstance(data, dict) and "properties" in schema:
        fields = schema["properties"]
        return set(data) <= set(fields) and set(schema.get("required", ())) <= set(data) and all(valid(v, fields[k]) for k, v in data.items())
    if isinstance(data, list) and "items" in schema:
        return all(valid(v, schema["items"]) for v in data)
    return True


def _order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Levels of the calls of one conversation from (id, dep), a null dep standing for none. Calls on or after a cycle or a missing part have none."""
    needs: dict[str, set] = {}
    for call, dep in zip(pdf["id"], pdf["dep"]):
        needs.setdefault(call, set()).update([] if dep is None else [dep])
    users: dict[str, list] = {}
    for call, deps in needs.items():
        for dep in deps:
            users.setdefault(dep, []).append(call)
    left, level = {call: len(deps) for call, deps in needs.items()}, {}
    ready = [call for call, n in left.items() if n == 0]
    level.update(dict.fromkeys(ready, 0))
    for call in ready:
        for user in users.get(call, ()):
            left[user] -= 1
            level[user] = max(level.get(user, 0), level[call] + 1)
            if left[user] == 0:
                ready.append(user)
    # Plain objects, also where no call has a level.
    return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]] * len(ready), "id": ready, "level": [level[c] for c in ready]}, dtype=object)


def _levels(calls: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """(conv_id, id, level): 0 without dependencies, else one more than the deepest; no row on a cycle or missing part."""
    kind = calls.schema["conv_id"].dataType.simpleString()
    deps = stage(calls.select("conv_id", "id", F.explode_outer("deps").alias("dep")).distinct(), "deps")
    sizes = deps.groupBy("conv_id").count()
    large = stage(sizes.where(f"count > {in_one_task}").select("conv_id"), "large")
    few = deps.join(large, "conv_id", "left_anti").groupBy("conv_id").applyInPandas(_order, f"conv_id {kind}, id string, level long")
    if large.isEmpty():
        return few
    # A conversation too large for one task: each round settles the calls whose dependencies are all settled.
    todo = stage(deps.join(large, "conv_id", "left_semi"), "todo")
    done, level = todo.where("dep is null").select("conv_id", "id", F.lit(0).cast("long").alias("level")), 0
    todo = todo.where("dep is not null")
    while True:
        level += 1
        done = stage(done, "levels")
        known = done.select("conv_id", F.col("id").alias("dep"), F.lit(True).alias("ok"))
        ready = todo.join(known, ["conv_id", "dep"], "left").groupBy("conv_id", "id").agg(F.every(F.col("ok").isNotNull()).alias("all_ok")).where("all_ok").select("conv_id", "id")
        ready = stage(ready, "ready")
        if ready.isEmpty():
            return few.unionByName(done)
        done = done.union(ready.withColumn("level", F.lit(level).cast("long")))
        todo = stage(todo.join(ready, ["conv_id", "id"], "left_anti"), "todo")


def link_tools(messages: DataFrame, schemas: Mapping[str, Mapping] | None = None) -> DataFrame:
    """One row per message: conv_id, turn, role, n_calls, n_answered, n_invalid, n_unknown, n_unlinkable, link, level, call_order, message.

    Calls and results are joined by (conv_id, call id), so a conversation is never gathered in one task. ``link``
    of a result is "linked", "early" (no call with that id before it) or "orphan" (none at all); null for
    other messages. Messages are told apart by a number of their own, also
    within one turn. Where an id is called twice the call of the first turn counts (a null turn last), of one turn that with the smallest list of dependencies; repeated rows stay, each answered alike. ``level`` is
    the topological level of the message's deepest call, or of the call a result answers; null on cycles. ``call_order`` lists the message's call ids in
    topological order (by level, then id; those on cycles last), comma-joined. Sorting by (level, turn) orders whole conversations. Calls of tools without a schema count as unknown, not as invalid;
    calls without an id as unlinkable. Messages of a null conversation link with nothing: their results are orphans. Long texts are read whole.
    ``message`` is canonical JSON (keys sorted, no blanks) of role and content. Null text, role and turn are null
    content, role "" and no order. Empty tables give empty results; extra columns are ignored.
    """
    schemas = dict(SCHEMAS if schemas is None else schemas)

    @F.pandas_udf(PARSED)
    def read(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t) for t in text], columns=["calls", "unlinkable", "result_id", "body"], dtype=object)

    @F.pandas_udf("int")
    def bad(calls: pd.Series) -> pd.Series:
        return calls.map(lambda cs: sum(c["name"] in schemas and not valid(json.loads(c["args"]), schemas[c["name"]]) for c in cs)).astype("int32")

    known_tool = F.array(*[F.lit(n) for n in schemas]).cast("array<string>")

    @F.pandas_udf("string")
    def write(role: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([canonical({"role": r or "", "content": b or ""}) for r, b in zip(role, body)], dtype=object)

    read_ = messages.select(F.monotonically_increasing_id().alias("message_no"), "conv_id", "turn", "role", read("text").alias("p"))
    # The number is staged with the message, so it stays.
    rows = stage(read_.select("message_no", "conv_id", "turn", "role", "p.*").withColumn("n_invalid", bad("calls")), "messages")
    first = F.min(F.struct(F.col("turn").isNull().alias("late"), "turn", "c.deps"))
    calls = rows.select("conv_id", "turn", F.explode("calls").alias("c")).groupBy("conv_id", F.col("c.id").alias("id")).agg(
        F.min("turn").alias("call_turn"), first["deps"].alias("deps"))
    calls = stage(calls, "calls")
    levels = _levels(calls)
    answered = rows.where("result_id is not null").groupBy("conv_id", F.col("result_id").alias("id")).agg(F.max("turn").alias("last_result"))
    known = stage(calls.drop("deps").join(levels, ["conv_id", "id"], "left").join(answered, ["conv_id", "id"], "left"), "known")
    per_message = rows.select("message_no", "conv_id", "turn", F.explode("calls.id").alias("id")).distinct().join(known, ["conv_id", "id"]).groupBy("message_no").agg(
        F.count_if(F.col("last_result") > F.col("turn")).alias("n_answered"), F.max("level").cast("int").alias("call_level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("level", F.lit(2**62)), "id"))), lambda x: x["id"]), ",").alias("call_order"))
    plain = rows.where((F.size("calls") == 0) & F.col("result_id").isNull()).withColumn("n_answered", F.lit(0).cast("long")).withColumn("call_level", F.lit(None).cast("int")).withColumn("call_order", F.lit(None).cast("string"))
    active = rows.where((F.size("calls") > 0) | F.col("result_id").isNotNull()).join(per_message, "message_no", "left")
    results = known.select("conv_id", F.col("id").alias("result_id"), "call_turn", F.col("level").cast("int").alias("result_level"))
    every = active.unionByName(plain)
    linked = every.where("result_id is not null").join(results, ["conv_id", "result_id"], "left").unionByName(every.where("result_id is null"), allowMissingColumns=True)
    link = F.when(F.col("result_id").isNull(), None).when(F.col("call_turn").isNull(), "orphan").when(F.col("call_turn") < F.col("turn"), "linked").otherwise("early")
    return linked.select(
        "conv_id", "turn", "role", F.size("calls").cast("long").alias("n_calls"), F.coalesce("n_answered", F.lit(0)).cast("long").alias("n_answered"),
        F.col("n_invalid").cast("long").alias("n_invalid"),
        F.size(F.filter("calls", lambda c: ~F.array_contains(known_tool, c["name"]))).cast("long").alias("n_unknown"), F.col("unlinkable").cast("long").alias("n_unlinkable"),
        link.alias("link"), F.coalesce("call_level", "result_level").alias("level"), F.coalesce("call_order", F.lit("")).alias("call_order"),
        write("role", "body").alias("message"),
    )


def op5_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tools(table(spark, sf_dir, "conversations"))
