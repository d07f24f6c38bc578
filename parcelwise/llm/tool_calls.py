"""Chat formatting: tool calls linked to their results.

Calls and results are hash-joined by conversation and identifier. A call may name the call whose
result it uses; its depth, the number of calls it rests on, comes from pointer doubling, so a chain of
n calls takes log2(n) joins, and (depth, turn, call_id) is a topological order, in which every call
gets its position. Arguments are checked
against the schema of the tool, and each call is serialised as canonical JSON: sorted keys, no blanks,
no escapes beyond those JSON needs.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import arrow_map, batch_of, checkpointed, stored

TURNS = 1024
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def problems(value: Any, schema: dict, path: str = "$") -> list[str]:
    """What keeps ``value`` from a JSON schema with type, enum, required, properties, additionalProperties, items and bounds."""
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{path}: not of type {kind}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{path}: not one of the values allowed")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{path}.{k}: missing" for k in sorted(schema.get("required", ())) if k not in value]
        for k in sorted(value):
            if k in known:
                found += problems(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{path}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += problems(x, schema["items"], f"{path}[{i}]")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            found.append(f"{path}: out of bounds")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{path}: too short")
        if len(value) > schema.get("maxLength", math.inf):
            found.append(f"{path}: too long")
    return found


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def judged(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[Any, str]:
    """The parsed arguments, and what is wrong with them ('' if nothing is)."""
    if name not in schemas:
        return None, "unknown tool"
    try:
        value = json.loads(arguments or "", parse_constant=lambda x: float("inf"))
        canonical(value).encode()
    except UnicodeEncodeError:  # an escaped half of a surrogate pair
        return None, "$: not Unicode"
    except (ValueError, RecursionError):
        return None, "$: not JSON"
    return value, "; ".join(problems(value, schemas[name]))


def depths(calls: DataFrame) -> DataFrame:
    """``calls`` (conv_id, call_id, after) with depth: 0 for a call that rests on none, -1 on a cycle.

    Each round doubles the distance that a pointer spans. A chain without a cycle ends within
    log2(calls) rounds; what has not ended then runs in a circle or into one.
    """
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    state = calls.join(known, ["conv_id", "after"], "left").select(
        "conv_id", "call_id", F.when(F.col("there"), F.col("after")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth")
    )
    state = checkpointed(state)
    rounds = max(1, math.ceil(math.log2(max(2, state.count())))) + 1
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            break
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = checkpointed(state.join(above, ["conv_id", "up"], "left").select(
            "conv_id", "call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        ))
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).otherwise(F.lit(-1)).alias("depth"))


def placed(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, position): place from 0 in the order (depth, turn, call_id) of the conversation.

    Calls on a cycle have none. Places are counted within blocks of a depth and 1,024 turns, and blocks
    are added up, so a conversation with most of the calls is not sorted by one task.
    """
    block = ["conv_id", "depth", "block"]
    rows = calls.where("depth >= 0").withColumn("block", F.expr(f"floor(turn / {TURNS})"))
    sizes = rows.groupBy(*block).count()
    before = Window.partitionBy("conv_id").orderBy("depth", "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*block, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    same = F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("r.depth") == F.col("s.depth")) & F.col("r.block").eqNullSafe(F.col("s.block"))
    within = Window.partitionBy("r.conv_id", "r.depth", "r.block").orderBy("r.turn", "r.call_id")
    return rows.alias("r").join(sizes.alias("s"), same).select(
        "r.conv_id", "r.call_id", (F.col("s.before") + F.row_number().over(within) - 1).alias("position")
    )


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, call_id, turn, depth, position, status and message of every call.

    ``calls`` has conv_id, call_id, turn, name, arguments (JSON text) and after (the call_id it rests on,
    or NULL); ``results`` has conv_id, call_id, turn and content. A call_id is unique in a conversation:
    of repeated calls the first by (turn, name, arguments, after) stays, of repeated results the first by
    (turn, content), NULL before other values. Calls with a NULL conv_id or call_id link to nothing and
    are left out, and so are results without a call. ``after`` that names no call counts as NULL.

    ``position`` is the call's place in the topological order of its conversation, NULL on a cycle. Texts
    and arguments of any length are handled whole; arguments with half a surrogate pair are invalid.

    status: 'ok', 'no result', 'cycle', or 'invalid: ...' with what is wrong with the arguments; of
    several, the last of these. message: {"arguments", "depth", "id", "name", "result"} as canonical JSON;
    arguments that are not JSON or whose tool is unknown stay as text.
    """
    first = lambda *names: F.min(F.struct(*(F.col(n) for n in names))).alias("first")
    named = "conv_id is not null and call_id is not null"
    calls = stored(
        calls.where(named).groupBy("conv_id", "call_id").agg(first("turn", "name", "arguments", "after"))
        .select("conv_id", "call_id", "first.*")
    )
    results = results.where(named).groupBy("conv_id", "call_id").agg(first("turn", "content")).select(
        "conv_id", "call_id", F.col("first.content").alias("content"), F.lit(True).alias("answered")
    )
    key = ["conv_id", "call_id"]
    deep = stored(calls.join(depths(calls), key))
    whole = deep.join(placed(deep), key, "left").join(results, key, "left")
    schema = pa.schema([("conv_id", pa.int64()), ("call_id", pa.string()), ("turn", pa.int64()), ("depth", pa.int64()), ("position", pa.int64()), ("status", pa.string()), ("message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            status, messages = [], []
            for r in rows:
                value, wrong = judged(r["name"], r["arguments"], schemas)
                value = r["arguments"] if value is None else value
                status.append(f"invalid: {wrong}" if wrong else "cycle" if r["depth"] < 0 else "ok" if r["answered"] else "no result")
                messages.append(canonical({"arguments": value, "depth": r["depth"], "id": r["call_id"], "name": r["name"], "result": r["content"]}))
            yield batch_of(schema, **{c: batch.column(c) for c in ("conv_id", "call_id", "turn", "depth", "position")}, status=status, message=messages)

    return arrow_map(
        whole.select(F.col("conv_id").cast("long"), F.col("call_id").cast("string"), F.col("turn").cast("long"), "depth", F.col("position").cast("long"), "name", "arguments", "content", "answered"),
        run, "conv_id long, call_id string, turn long, depth long, position long, status string, message string",
    )
