"""Chat formatting with tool-call linking.

Calls and results are hash-joined by conversation and call identifier. A call may wait for another call's result;
chains of such calls are followed by pointer doubling, so a chain of n calls takes log n joins. The topological
order is given as columns to sort by, (order_turn, depth, step): no conversation is gathered in one task, whatever
its length. Arguments are checked against the tool's JSON schema and rows serialised as canonical JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.store import written

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_OUT = "conv_id long, turn long, kind string, call_id string, order_turn long, depth long, step int, status string, error string, json string"


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks and no escapes but the needed ones."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parse(text: str | None) -> object:
    def refuse(name: str) -> None:
        raise ValueError(f"{name} is not JSON")

    return json.loads(text or "", parse_constant=refuse)


def violation(schema: dict, value: object, path: str = "$") -> str | None:
    """The first way in which the value breaks the schema, or None."""
    kind = schema.get("type")
    if kind in ("integer", "number"):
        right = isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
    else:
        right = kind is None or isinstance(value, _KINDS[kind])
    if not right:
        return f"{path}: not of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not one of the allowed values"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{path}: out of range"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{path}: length out of range"
    if isinstance(value, dict):
        missing = sorted(set(schema.get("required", ())) - set(value))
        if missing:
            return f"{path}: lacks {missing[0]}"
        known = schema.get("properties", {})
        for name in sorted(value):
            if name in known:
                if found := violation(known[name], value[name], f"{path}.{name}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{path}: unknown {name}"
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if found := violation(schema["items"], item, f"{path}[{i}]"):
                return found
    return None


def _serialise(schemas: dict[str, dict]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, texts, states = [], [], []
            for r in batch.select(["kind", "call_id", "status", "role", "content", "name"]).to_pylist():
                error, status = None, r["status"]
                if r["kind"] == "call":
                    arguments = r["content"]
                    try:
                        value = parse(arguments)
                        arguments = canonical(value)
                        error = violation(schemas[r["name"]], value) if r["name"] in schemas else f"unknown tool {r['name']}"
                    except (ValueError, RecursionError) as broken:
                        error = f"arguments are not JSON: {broken}"[:200]
                    if error and status == "ok":
                        status = "invalid"
                    function = {"arguments": arguments, "name": r["name"]}
                    row = {"role": "assistant", "tool_calls": [{"function": function, "id": r["call_id"], "type": "function"}]}
                elif r["kind"] == "result":
                    row = {"content": r["content"], "role": "tool", "tool_call_id": r["call_id"]}
                else:
                    row = {"content": r["content"], "role": r["role"]}
                errors.append(error)
                states.append(status)
                texts.append(canonical(row))
            same = {c: batch.column(c) for c in ("conv_id", "turn", "kind", "call_id", "order_turn", "depth", "step")}
            yield pa.RecordBatch.from_arrays(
                [*same.values(), pa.array(states, pa.string()), pa.array(errors, pa.string()), pa.array(texts, pa.string())],
                [*same, "status", "error", "json"])

    return rows


def _chains(calls: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id``, ``order_turn``, ``depth``, ``circular`` of calls (one row each) with ``done`` and ``after``.

    ``done`` is the turn by which a call and its result are there.
    """
    known = calls.select(F.col("conv_id").alias("k"), F.col("call_id").alias("anc"))
    linked = calls.join(known, (F.col("conv_id") == F.col("k")) & (F.col("after") == F.col("anc")), "left")
    linked = written(linked.select("conv_id", "call_id", "turn", "done", "anc"), "chains")
    # of a call and those that it hangs on, up to but without anc: the latest turn, and how many there are
    hop = written(linked.select("conv_id", "call_id", F.col("done").alias("m"), F.lit(1).cast("long").alias("n"), "anc"), "hops")
    for _ in range(linked.count().bit_length() + 1):
        active = hop.filter("anc is not null")
        if not active.limit(1).count():
            break
        up = hop.select(F.col("conv_id").alias("k"), F.col("call_id").alias("at"), F.col("m").alias("m2"), F.col("n").alias("n2"), F.col("anc").alias("anc2"))
        further = active.join(up, (F.col("conv_id") == F.col("k")) & (F.col("anc") == F.col("at"))).select(
            "conv_id", "call_id", F.greatest("m", "m2").alias("m"), (F.col("n") + F.col("n2")).alias("n"), F.col("anc2").alias("anc"))
        hop = written(hop.filter("anc is null").union(further), "hops")
    # still on the way after so many rounds: it goes round in a circle
    own = hop.select("conv_id", "call_id", F.col("anc").isNotNull().alias("circular"))
    before = hop.select(F.col("conv_id").alias("k"), F.col("call_id").alias("at"), "m", "n")
    placed = linked.join(before, (F.col("conv_id") == F.col("k")) & (F.col("anc") == F.col("at")), "left")
    placed = placed.select("conv_id", "call_id", F.greatest("turn", "m").alias("order_turn"), F.coalesce("n", F.lit(0).cast("long")).alias("depth"))
    return placed.join(own, ["conv_id", "call_id"])


def link_tool_calls(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per message, call and result: ``conv_id, turn, kind, call_id, order_turn, depth, step, status, error, json``.

    messages: conv_id, turn, role, content; calls: conv_id, turn, call_id, name, arguments (JSON), after (the
    call whose result it needs, or null); results: conv_id, turn, call_id, content. Sorted by (order_turn, depth,
    step) a conversation has every result after its call and every call after the results it needs. Status:
    ``ok``; ``unanswered`` calls; ``invalid`` arguments (``error`` says why); ``circular`` calls, which wait for
    themselves; ``orphan`` results, without a call; ``duplicate`` for all but the first (by turn, then text) call or
    result of an identifier, equal repeated rows being one. An unknown ``after`` counts as none. Null
    conversations or identifiers link with nothing; null turns come first; null contents are JSON null. Extra
    columns play no part. Empty tables give no rows.
    """
    key = ["conv_id", "call_id"]
    calls = calls.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"), "name", "arguments", "after").distinct()
    results = results.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"), "content").distinct()
    named = "conv_id is not null and call_id is not null"
    first_call = calls.filter(named).groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"))
    first_result = results.filter(named).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"))
    pair = first_call.join(first_result, key, "left")
    chain = _chains(pair.select(*key, F.col("c.turn").alias("turn"), F.greatest("c.turn", "r.turn").alias("done"), F.col("c.after").alias("after")))
    state = written(pair.join(chain, key), "linked")

    call_state = state.select(*key, "c", F.col("r").isNotNull().alias("answered"), "order_turn", "depth", "circular")
    this = F.struct("turn", "name", "arguments", "after")
    call_rows = calls.join(call_state, key, "left").select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.coalesce("order_turn", "turn").alias("order_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.lit(1).alias("step"),
        F.when(F.col("c").isNotNull() & ~F.col("c").eqNullSafe(this), "duplicate").when(F.col("circular"), "circular")
        .when(F.coalesce("answered", F.lit(False)), "ok").otherwise("unanswered").alias("status"),
        F.lit("assistant").alias("role"), F.col("arguments").alias("content"), "name")
    result_state = first_result.join(state.select(*key, "order_turn", "depth"), key, "left")
    result_rows = results.join(result_state, key, "left").select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.greatest("turn", "order_turn").alias("order_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.lit(2).alias("step"),
        F.when(F.col("depth").isNull(), "orphan").when(~F.col("r").eqNullSafe(F.struct("turn", "content")), "duplicate").otherwise("ok").alias("status"),
        F.lit("tool").alias("role"), "content", F.lit(None).cast("string").alias("name"))
    message_rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
        F.col("turn").cast("long").alias("order_turn"), F.lit(-1).cast("long").alias("depth"), F.lit(0).alias("step"), F.lit("ok").alias("status"), "role", "content",
        F.lit(None).cast("string").alias("name"))
    return message_rows.union(call_rows).union(result_rows).mapInArrow(_serialise(schemas), _OUT)
