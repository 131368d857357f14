"""Chat formatting: tool calls linked to their results, in dependency order, as canonical JSON.

Messages have conv_id, seq, role, content, tool_calls (JSON list of {id, name,
arguments}) and tool_call_id (on results). Calls and results are joined on
(conversation, identifier). An argument {"$result": id} makes a call depend on
another; calls get levels so that every call stands after all it depends on.
No conversation is gathered anywhere: order is (conv_id, level, seq, place).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.llm.common import materialise, query, table
from linklens.session import ship_package

#: Deepest nesting of a call; deeper JSON is malformed.
MAX_DEPTH = 128
CALLS = ("conv_id string, seq bigint, place int, call_id string, name string, arguments string, error string, "
         "needs array<string>")
_TYPES: dict[str, tuple[type, ...]] = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,),
                                       "array": (list,), "object": (dict,), "null": (type(None),)}


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces: equal values give equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _finite(text: str) -> int | float:
    """A JSON number with a point or exponent; whole ones as integers, so that 1 and 1.0 give one text."""
    number = float(text)
    if not math.isfinite(number):
        raise ValueError(f"{text} is out of range")
    return int(number) if number.is_integer() else number


def _no_constant(text: str) -> None:
    raise ValueError(f"{text} is not JSON")


def read_json(text: str) -> Any:
    """The value of ``text``; ValueError where it is no JSON, nests deeper than ``MAX_DEPTH``, or holds NaN, numbers
    out of range, or escapes of lone surrogates, which no UTF-8 text can hold."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_no_constant)
    except RecursionError:
        raise ValueError("nested too deep") from None
    layer = [value]
    for _ in range(MAX_DEPTH):
        layer = [v for x in layer if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x)]
        if not layer:
            break
    else:
        raise ValueError("nested too deep")
    canonical(value).encode()  # UnicodeEncodeError is a ValueError
    return value


def is_reference(value: Any) -> bool:
    return isinstance(value, dict) and set(value) == {"$result"} and isinstance(value["$result"], str)


def references(value: Any) -> list[str]:
    """Identifiers named by {"$result": id} anywhere in ``value``, each once, ascending."""
    if is_reference(value):
        return [value["$result"]]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return sorted({r for v in inner for r in references(v)})


def schema_error(value: Any, schema: Mapping[str, Any], path: str = "$") -> str | None:
    """First offence of ``value`` against a JSON schema (type, enum, minimum, maximum, items, properties, required,
    additionalProperties); a reference fits any type."""
    if is_reference(value):
        return None
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or (isinstance(value, bool) and kind in ("integer", "number"))):
        return f"{path}: not {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not in enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            return f"{path}: under minimum"
        if "maximum" in schema and value > schema["maximum"]:
            return f"{path}: over maximum"
    if isinstance(value, list) and "items" in schema:
        return next((e for i, v in enumerate(value) if (e := schema_error(v, schema["items"], f"{path}[{i}]"))), None)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in sorted(schema.get("required", ())):
            if name not in value:
                return f"{path}: no {name}"
        for name in sorted(value):
            if name not in known:
                if schema.get("additionalProperties", True) is False:
                    return f"{path}: unknown {name}"
            elif error := schema_error(value[name], known[name], f"{path}.{name}"):
                return error
    return None


def read_calls(raw: str | None, schemas: Mapping[str, Mapping[str, Any]]) -> list[tuple]:
    """(place, call_id, name, canonical arguments, error, needs) of the calls in a message."""
    if raw is None:
        return []
    try:
        calls = read_json(raw)
    except ValueError:
        return [(0, None, None, None, "malformed", [])]
    out = []
    for place, call in enumerate(calls if isinstance(calls, list) else [calls]):
        if not isinstance(call, dict) or not isinstance(call.get("id"), str):
            out.append((place, None, None, None, "malformed", []))
            continue
        arguments, name = call.get("arguments", {}), call.get("name")
        if isinstance(arguments, str):
            try:
                arguments = read_json(arguments)
            except ValueError:
                out.append((place, call["id"], name if isinstance(name, str) else None, None, "malformed", []))
                continue
        if not isinstance(name, str) or name not in schemas:
            error = "unknown_tool"
        else:
            found = schema_error(arguments, schemas[name])
            error = f"invalid_arguments {found}" if found else None
        out.append((place, call["id"], name if isinstance(name, str) else None, canonical(arguments), error,
                    references(arguments)))
    return out


def extract_calls(messages: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """One row for each call of every message, arguments validated and canonical."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(conv, seq, *call) for conv, seq, raw in pdf.itertuples(index=False, name=None)
                    for call in read_calls(raw, schemas)]
            yield pd.DataFrame(rows, columns=["conv_id", "seq", "place", "call_id", "name", "arguments", "error",
                                              "needs"])

    ship_package(messages.sparkSession)
    return (messages.select(F.col("conv_id").cast("string"), F.coalesce("seq", F.lit(-1)).cast("bigint"), "tool_calls")
            .filter(F.col("tool_calls").isNotNull()).mapInPandas(extract, CALLS))


def chains(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, need, far): each call with one need, and the first call down its chain that has none or several.

    ``edges``: (conv_id, call_id, need) of calls with exactly one need. Pointer
    doubling: a chain of n calls takes log2(n) rounds. Calls on a cycle, or
    behind one, have no row.
    """
    at = ["conv_id", "need"]
    jumps = materialise(edges.join(edges.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("open")), at, "left")
                        .select("conv_id", "call_id", "need", F.lit(1).cast("long").alias("far"),
                                F.coalesce("open", F.lit(False)).alias("open")), "jumps")
    for _ in range(jumps.count().bit_length() + 1):  # what is open after these rounds never ends
        if jumps.filter("open").isEmpty():
            break
        ends = jumps.select("conv_id", F.col("call_id").alias("need"), F.col("need").alias("next"), F.col("far").alias("more"),
                            F.col("open").alias("still"))
        moved = (jumps.filter("open").join(ends, at)
                 .select("conv_id", "call_id", F.col("next").alias("need"), (F.col("far") + F.col("more")).alias("far"),
                         F.col("still").alias("open")))
        jumps = materialise(jumps.filter("NOT open").unionByName(moved), "jumps")
    return jumps.filter("NOT open").drop("open")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without needs, else one more than the highest level needed.

    ``calls``: conv_id, call_id, needs. Needs of absent calls count as met.
    Calls on a cycle, or behind one, have no row. Calls with one need are
    followed by pointer doubling to the end of their chain (:func:`chains`);
    rounds are left for calls with several needs alone, as many as stand above
    each other.
    """
    own = calls.select("conv_id", "call_id").distinct()
    edges = (calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
             .join(own.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_semi"))
    key = ["conv_id", "call_id"]
    edges = materialise(edges.join(edges.groupBy(*key).agg(F.count(F.lit(1)).alias("needs")), key)
                        .select(*key, "need", "needs"), "edges")
    chained = materialise(chains(edges.filter("needs = 1").drop("needs")), "chains")
    # calls with several needs wait for the calls where the chains of their needs end
    several = edges.filter("needs > 1").drop("needs")
    ends = chained.select("conv_id", F.col("call_id").alias("need"), F.col("need").alias("end"), "far")
    singles = edges.filter("needs = 1").select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("single"))
    waiting = (several.join(ends, ["conv_id", "need"], "left").join(singles, ["conv_id", "need"], "left")
               # a need that is chained but without an end is on a cycle: it waits for ever
               .select(*key, F.when(F.col("single") & F.col("end").isNull(), F.lit(None)).otherwise(F.coalesce("end", "need"))
                       .alias("need"), (F.coalesce("far", F.lit(0)) + 1).alias("far"), F.lit(None).cast("long").alias("level")))
    waiting = materialise(waiting, "waiting")
    ready = materialise(own.join(edges, key, "left_anti").withColumn("level", F.lit(0).cast("long")), "level")
    done = ready
    while not waiting.isEmpty():
        known = ready.select("conv_id", F.col("call_id").alias("need"), F.col("level").alias("at"))
        waiting = waiting.join(known, ["conv_id", "need"], "left").select(
            *key, "need", "far", F.coalesce("level", F.col("at") + F.col("far")).alias("level"))
        waiting = materialise(waiting, "waiting")
        ready = materialise(waiting.groupBy(*key).agg(F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
                            .filter("open = 0").drop("open"), "level")
        if ready.isEmpty():
            break
        waiting, done = waiting.join(ready, key, "left_anti"), done.unionByName(ready)
    tops = done.select("conv_id", F.col("call_id").alias("need"), "level")
    above = chained.join(tops, ["conv_id", "need"]).select(*key, (F.col("level") + F.col("far")).alias("level"))
    return done.unionByName(above).withColumn("level", F.col("level").cast("int"))


def link_tool_calls(messages: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """One row per call: conv_id (text), seq, place, call_id, name, level, status, line.

    status, the first that holds: malformed, duplicate_id (an earlier call of the
    conversation has the identifier), unknown_tool, invalid_arguments, cycle,
    missing_result, ok. Malformed is also what :func:`read_json` refuses: NaN,
    lone surrogates, nesting beyond ``MAX_DEPTH``. ``line``: canonical JSON of the call, its status and its
    result. The earliest result of an identifier counts (ties: the least
    content); results without a call and messages without calls give no row.
    Null conversations are one conversation, a null seq stands first, and
    repeated messages repeat their calls as duplicates. Other columns are not
    read. An empty table gives an empty result.
    """
    # calls at one place are told apart by what they say, and by a number where they say the same
    found = materialise(extract_calls(messages, schemas).withColumn("conv_id", F.coalesce("conv_id", F.lit("")))
                        .withColumn("at", F.struct("seq", "place", F.xxhash64("name", "arguments", "error").alias("said"),
                                                   F.monotonically_increasing_id().alias("row"))), "calls")
    at = F.col("at")
    firsts = found.filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(at).alias("first"))
    results = (messages.filter(F.col("tool_call_id").isNotNull())
               .select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"),
                       F.col("tool_call_id").cast("string").alias("call_id"),
                       F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), "content").alias("r"))
               .groupBy("conv_id", "call_id").agg(F.min("r").alias("result")))
    linked = (found.join(firsts, ["conv_id", "call_id"], "left").join(results, ["conv_id", "call_id"], "left")
              .withColumn("is_first", at.eqNullSafe(F.col("first"))))
    linked = materialise(linked, "linked")
    order = levels(linked.filter("is_first").select("conv_id", "call_id", "needs"))
    joined = linked.join(order, ["conv_id", "call_id"], "left")
    status = (F.when(F.col("error") == "malformed", "malformed").when(~F.col("is_first"), "duplicate_id")
              .when(F.col("error") == "unknown_tool", "unknown_tool").when(F.col("error").isNotNull(), "invalid_arguments")
              .when(F.col("level").isNull(), "cycle").when(F.col("result").isNull(), "missing_result").otherwise("ok"))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = [canonical({"id": i, "name": n, "arguments": None if a is None else json.loads(a), "status": s,
                                "result": r}) for i, n, a, s, r in
                     zip(*(pdf[c] for c in ("call_id", "name", "arguments", "status", "result")), strict=True)]
            yield pdf.drop(columns=["arguments", "result"]).assign(line=lines)

    flat = joined.select("conv_id", "seq", "place", "call_id", "name", F.col("level").cast("string").alias("level"),
                         status.alias("status"), "arguments", F.col("result.content").alias("result"))
    return (flat.mapInPandas(render, "conv_id string, seq bigint, place int, call_id string, name string, level string, "
                                     "status string, line string")
            .withColumn("level", F.col("level").cast("int")))


#: Tools of the messages derived from ``conversations``.
SCHEMAS: dict[str, dict[str, Any]] = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {
        "query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "summarise": {"type": "object", "required": ["text", "style"], "additionalProperties": False, "properties": {
        "text": {"type": "string"}, "style": {"type": "string", "enum": ["short", "long"]}}},
}


def derived_messages(conversations: DataFrame) -> DataFrame:
    """Tool traffic with the shape of ``conversations`` (conv_id, turn, role, text), which has none itself.

    Each user turn becomes a call ``c<turn>``: a search for the text (its limit is
    out of range for some lengths), or every second time a summary of the result
    of the call two turns before. Each assistant turn becomes the result of the
    turn before it. System turns carry neither.
    """
    turn, size = F.col("turn"), F.char_length(F.coalesce("text", F.lit("")))
    call_id = F.concat(F.lit("c"), turn)
    before = F.concat(F.lit("c"), turn - 2)
    search = F.to_json(F.array(F.struct(
        call_id.alias("id"), F.lit("search").alias("name"),
        F.struct(F.col("text").alias("query"), (size % 60).alias("limit")).alias("arguments"))))
    summary = F.to_json(F.array(F.struct(
        call_id.alias("id"), F.lit("summarise").alias("name"),
        F.struct(F.struct(before.alias("$result")).alias("text"),
                 F.when(size % 2 == 0, "short").otherwise("long").alias("style")).alias("arguments"))))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select(
        "conv_id", turn.alias("seq"), "role", F.col("text").alias("content"),
        F.when(user & (turn % 4 < 2), search).when(user, summary).alias("tool_calls"),
        F.when(assistant, F.concat(F.lit("c"), turn - 1)).alias("tool_call_id"))


@query("op5_tool_calls")
def op5_tool_calls(spark, sf_dir):
    return link_tool_calls(derived_messages(table(spark, sf_dir, "conversations")), SCHEMAS)
