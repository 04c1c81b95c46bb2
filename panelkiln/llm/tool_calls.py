"""Operator 7, linking of tool calls and their results."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm.shared import MOST_HOT, cut, small_batches, table

_TYPES = {
    "object": lambda x: isinstance(x, dict), "array": lambda x: isinstance(x, list), "string": lambda x: isinstance(x, str), "boolean": lambda x: isinstance(x, bool), "null": lambda x: x is None,
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(), "number": lambda x: isinstance(x, int | float) and not isinstance(x, bool),
}


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a JSON schema (type, enum, const, required, properties, additionalProperties, items, and bounds of numbers, lengths and patterns), each with its place."""
    out: list[str] = []
    if types := schema.get("type"):
        named = [types] if isinstance(types, str) else types
        if unknown := [t for t in named if t not in _TYPES]:
            return [f"{at}: schema has no type {unknown[0]}"]
        if not any(_TYPES[t](value) for t in named):
            return [f"{at}: not {types}"]
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        out.append(f"{at}: not an allowed value")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            more = known.get(k, schema.get("additionalProperties", True))
            if more is False:
                out.append(f"{at}.{k}: not allowed")
            elif isinstance(more, dict):
                out += violations(value[k], more, f"{at}.{k}")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    size = len(value) if isinstance(value, str | list) else None
    number = value if isinstance(value, int | float) and not isinstance(value, bool) else None
    for key, got, ok in (
        ("minLength", size if isinstance(value, str) else None, lambda a, b: a >= b), ("maxLength", size if isinstance(value, str) else None, lambda a, b: a <= b),
        ("minItems", size if isinstance(value, list) else None, lambda a, b: a >= b), ("maxItems", size if isinstance(value, list) else None, lambda a, b: a <= b),
        ("minimum", number, lambda a, b: a >= b), ("maximum", number, lambda a, b: a <= b),
    ):
        if key in schema and got is not None and not ok(got, schema[key]):
            out.append(f"{at}: {key} {schema[key]}")
    if isinstance(value, str) and "pattern" in schema:
        try:
            if not re.search(schema["pattern"], value):
                out.append(f"{at}: pattern")
        except re.error:
            out.append(f"{at}: schema has no valid pattern")
    return out


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and whole floats as integers; equal values give equal texts."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and math.isfinite(x) and x.is_integer() and abs(x) < 2**53 else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


#: Arguments may be nested so deep.
DEEPEST = 200


def _no_number(text: str):
    raise ValueError(text)


def _finite(text: str) -> float:
    x = float(text)
    return x if math.isfinite(x) else _no_number(text)


def arguments_of(text: str | None) -> tuple[object, list[str]]:
    """The value of a call's arguments, or their text as it is and why they aren't usable: no JSON, numbers that JSON can't write, nested beyond DEEPEST levels."""
    try:
        value = json.loads(text, parse_constant=_no_number, parse_float=_finite)
        level, depth = [value], 0
        while level := [y for x in level if isinstance(x, dict | list) for y in (x.values() if isinstance(x, dict) else x)]:
            depth += 1
            if depth >= DEEPEST:
                return text, ["$: nested too deep"]
    except RecursionError:
        return text, ["$: nested too deep"]
    except (TypeError, ValueError):
        return text, ["$: no JSON"]
    return value, []


def _whole(text: str) -> str:
    """Half surrogates, which no UTF-8 text can hold, become U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def depths(parents: DataFrame) -> DataFrame:
    """call_id, depth, root_id, cyclic of each (call_id, parent_id), ids distinct, by pointer doubling.

    A parent that isn't a call counts as none. Each round doubles the distance of the ancestor that is pointed at, so a chain of n calls takes
    log2(n) rounds; what still points on after log2 of all calls is on a cycle or below one, and has no depth.
    """
    ids = parents.select(F.col("call_id").alias("_id"))
    state = parents.join(ids, F.col("parent_id") == F.col("_id"), "left").select(
        "call_id", F.col("_id").alias("up"), F.when(F.col("_id").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("_id", "call_id").alias("root_id")
    )
    state = cut(state)
    n = state.count()
    for _ in range(max(1, n).bit_length() + 1):
        if not state.filter("up is not null").limit(1).count():
            break
        above = state.select(F.col("call_id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("root_id").alias("_root"))
        moved = state.filter("up is not null").join(above, F.col("up") == F.col("_id")).select(
            "call_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_root").alias("root_id")
        )
        state = cut(state.filter("up is null").unionByName(moved))
    cyclic = F.col("up").isNotNull()
    return state.select("call_id", F.when(~cyclic, F.col("depth")).alias("depth"), F.when(~cyclic, F.col("root_id")).alias("root_id"), cyclic.alias("cyclic"))


def more_results(results: DataFrame, got: DataFrame, calls: DataFrame, order: DataFrame) -> DataFrame:
    """The results that aren't the first of their identifier (in got), a row each: with the least call of the identifier as more_result, or as no_call.

    results has the row number _at, got has one row per identifier with the _at of its first result. Identifiers of many results (at most MOST_HOT, by
    construction) are dealt out in parts of about equal size, and their one row of got goes to each part.
    """
    columns = ["call_id", "name", "arguments", "result", "status", "n_results", "depth", "root_id", "cyclic"]
    none = lambda kind: F.lit(None).cast(kind)
    lost = results.filter("call_id is null").select(
        "call_id", none("string").alias("name"), none("string").alias("arguments"), F.col("content").alias("result"), F.lit("no_call").alias("status"), F.lit(1).cast("long").alias("n_results"),
        none("long").alias("depth"), none("string").alias("root_id"), F.lit(False).alias("cyclic"),
    )
    many = got.filter("n_results > 1").select("_rid", "n_results", F.col("_at").alias("_first"))
    if many.isEmpty():
        return lost
    rest = results.filter("call_id is not null").join(many.select("_first"), F.col("_at") == F.col("_first"), "left_anti")
    hot_from = max(32, -(-results.count() // MOST_HOT))
    parts = F.ceil(F.col("n_results") / hot_from)
    hot = many.filter(F.col("n_results") >= hot_from).select(F.col("_rid").alias("_hot"), parts.alias("_parts"))
    dealt = rest.join(F.broadcast(hot), F.col("call_id") == F.col("_hot"), "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_at"), "_parts"), F.lit(0).cast("long")))
    least = calls.join(many.select(F.col("_rid").alias("call_id")), "call_id", "left_semi").groupBy("call_id").agg(F.min(F.struct("name", "arguments")).alias("_c"), F.lit(True).alias("_called"))
    told = many.join(least, F.col("_rid") == F.col("call_id"), "left").drop("call_id").join(order, F.col("_rid") == F.col("call_id"), "left").select(
        "_rid", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n_results") >= hot_from, parts - 1).otherwise(0).cast("long"))).alias("_to"), "n_results", "_called", "depth", "root_id", "cyclic",
        F.col("_c.name").alias("name"), F.col("_c.arguments").alias("arguments"),
    )
    more = dealt.join(told, (F.col("call_id") == F.col("_rid")) & (F.col("_part") == F.col("_to")))
    more = more.withColumns({"result": F.col("content"), "status": F.when(F.col("_called"), "more_result").otherwise("no_call"), "cyclic": F.coalesce("cyclic", F.lit(False))})
    return lost.unionByName(more.select(columns))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], every_result: bool = False) -> DataFrame:
    """One row per call, and per identifier of results without a call; with `every_result` (as the query has it) also one per further result.

    calls: call_id, parent_id, name, arguments (JSON text); results: call_id, content. Returns call_id, name, status (linked, no_result, no_call, more_result), n_results,
    depth, root_id, cyclic, valid, errors, message (canonical JSON of call_id, name, arguments, result). A parent stands before its
    children in the order of (root_id, depth, call_id).

    Results are gathered by identifier before the join: the least content that isn't null is the identifier's first result and stands in the rows of its
    calls, n_results counts all. Without `every_result` the other contents, and results with null identifiers, are in no row. With it each of them has its own
    row: status more_result with the identifier's least call (by name and arguments), or no_call where there is none, as always for null identifiers
    (n_results 1). So rows grow with calls plus results, never with their product; null identifiers link with nothing. Calls that repeat an identifier are a row each, and take its least parent. Arguments that are null
    or no JSON, numbers beyond a double's range, nesting beyond DEEPEST levels, and names without a schema, are invalid; their text stands in the message as it is.
    Half surrogates become U+FFFD. Empty tables give no rows.
    """
    results = cut(results.select("call_id", "content", F.monotonically_increasing_id().alias("_at")))
    first = F.min(F.struct(F.col("content").isNull().alias("none"), "content", "_at")).alias("_f")
    got = results.filter("call_id is not null").groupBy(F.col("call_id").alias("_rid")).agg(first, F.count(F.lit(1)).alias("n_results"))
    got = cut(got.select("_rid", F.col("_f.content").alias("result"), F.col("_f._at").alias("_at"), "n_results"))
    calls = cut(calls.select("call_id", "parent_id", "name", "arguments"))
    order = depths(cut(calls.filter("call_id is not null").groupBy("call_id").agg(F.min("parent_id").alias("parent_id"))))
    linked = (
        calls.drop("parent_id").join(got, F.col("call_id") == F.col("_rid"), "left").join(order, "call_id", "left")
        .select("call_id", "name", "arguments", "result", F.when(F.col("_rid").isNull(), "no_result").otherwise("linked").alias("status"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "depth", "root_id", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    )
    named = calls.filter("call_id is not null").select(F.col("call_id").alias("_cid")).distinct()
    alone = got.join(named, F.col("_rid") == F.col("_cid"), "left_anti").select(F.col("_rid").alias("call_id"), "result", F.lit("no_call").alias("status"), "n_results", F.lit(False).alias("cyclic"))
    schema = "call_id string, name string, status string, n_results long, depth long, root_id string, cyclic boolean, valid boolean, errors string, message string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                name = None if pd.isna(r.name) else r.name
                result = None if pd.isna(r.result) else r.result
                arguments = None if pd.isna(r.arguments) else r.arguments
                errors: list[str] = []
                if r.status != "no_call":
                    arguments, errors = arguments_of(arguments)
                    errors = errors or (violations(arguments, schemas[name]) if name in schemas else ["$: no schema"])
                message = canonical({"call_id": None if pd.isna(r.call_id) else r.call_id, "name": name, "arguments": arguments, "result": result})
                rows.append((not errors and r.status != "no_call", _whole("; ".join(errors)), _whole(message)))
            more = pd.DataFrame(rows, columns=["valid", "errors", "message"])
            out = pd.concat([b[["call_id", "name", "status", "n_results", "depth", "root_id", "cyclic"]].reset_index(drop=True), more], axis=1)
            yield out.assign(depth=out["depth"].astype("Int64"))

    rows = linked.unionByName(alone, allowMissingColumns=True)
    if every_result:
        rows = rows.unionByName(more_results(results, got, calls, order))
    return rows.mapInPandas(run, schema)


#: The schema that the query's calls are held against.
ASK = {"type": "object", "required": ["query", "turn"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}


def as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as calls and results: each user turn asks, identified by conversation and turn, its parent being two turns before; an assistant's turn answers the turn before it."""
    name = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    some = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    calls = conversations.filter("role = 'user'").select(
        F.when(some, name(0)).alias("call_id"), F.when(some, name(2)).alias("parent_id"), F.lit("ask").alias("name"),
        F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("query"), "turn")).alias("arguments"),
    )
    return calls, conversations.filter("role = 'assistant'").select(F.when(some, name(1)).alias("call_id"), F.col("text").alias("content"))


def other_turns(conversations: DataFrame) -> DataFrame:
    """The turns that as_calls doesn't take (system, tool, any other role or none), a row each with status other_role; message is the canonical JSON of conv_id, turn, role, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["message"] = [canonical({"conv_id": None if c is None else int(c), "turn": None if t is None else int(t), "role": r, "text": x}) for c, t, r, x in zip(b["_conv"], b["_turn"], b["role"], b["text"], strict=True)]
            yield b[["_conv", "_turn", "message"]]

    other = conversations.filter("role is null or role not in ('user', 'assistant')")
    # numbers travel as texts, as pandas would make floats of columns with nulls
    rows = other.select(F.col("conv_id").cast("string").alias("_conv"), F.col("turn").cast("string").alias("_turn"), "role", "text").mapInPandas(run, "_conv string, _turn string, message string")
    return rows.select(
        F.col("_conv").cast("long").alias("conv_id"), F.col("_turn").cast("long").alias("turn"), F.lit("other_role").alias("status"), F.lit(0).cast("long").alias("n_results"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("root_id"), F.lit(False).alias("valid"), "message",
    )


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns; conv_id, turn, status, n_results, depth, root_id, valid, message_sha256. Turns of users and assistants are linked, an answer in the row of its question; others are a row each."""
    small_batches(spark)
    turns = table(spark, sf_dir, "conversations")
    calls, results = as_calls(turns)
    out = link_tool_calls(calls, results, {"ask": ASK}, every_result=True)
    part = lambda i: F.split_part("call_id", F.lit("-"), F.lit(i)).cast("long")
    out = out.select(part(1).alias("conv_id"), part(2).alias("turn"), "status", "n_results", "depth", "root_id", "valid", "message").unionByName(other_turns(turns))
    return out.withColumn("message_sha256", F.sha2("message", 256)).drop("message")
