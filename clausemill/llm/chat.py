"""Chat formatting with DataFrame functions only: tool calls linked, ordered, validated and serialised.

An assistant turn whose text is a JSON object with `tool_calls` (objects with id, name, arguments) makes calls; a tool
turn whose text is a JSON object with `tool_call_id` is a result; anything else is a plain message. Calls and
results are hash-joined by conversation and identifier. A call depends on the results whose identifiers its arguments
name as `$id`, a result on its call; dependencies are peeled off level by level, and a round reads only what the round
before settled and what is still open. A node's place is the latest turn among itself and all it depends on, then its
level, so ordering by (place, level, turn, part) is topological and otherwise keeps the turns' order. Arguments are checked
against the tool's JSON schema. Each row carries one message, so a conversation of any length is never gathered in one
place; calls and results without an identifier meet nothing and are in no join.

JSON is canonical: keys sorted, no spaces; it is parsed and written by Spark's variant type, whose objects are sorted.

Defined cases: null text and role are empty strings; text that isn't the JSON described is a plain message; a call or
result without an id, a repeated id, a result without a call, a call without a result, unknown tools, bad arguments
and circular dependencies (level null) are named in `problems`; of calls with one id the first in order counts.
Repeated rows are repeated messages. Columns beyond the four aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, written
from .common import join_on

#: tool → JSON schema of its arguments. Understood are type (one, or several), properties, required, additionalProperties,
#: items, enum, minimum, maximum, minLength, maxLength, minItems, maxItems and pattern. It lives in the plan.
Schemas = dict[str, dict]

TOOLS: Schemas = {
    "search": {
        "type": "object", "required": ["query"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}, "fields": {"type": "array", "items": {"type": "string"}, "maxItems": 10}},
    },
    "calculator": {"type": "object", "required": ["expression"], "additionalProperties": False, "properties": {"expression": {"type": "string"}}},
    "weather": {
        "type": "object", "required": ["city"], "additionalProperties": False,
        "properties": {
            "city": {"type": "string"}, "days": {"type": "integer", "minimum": 1}, "metric": {"type": "boolean"}, "unit": {"enum": ["celsius", "kelvin"]},
            "at": {"type": "object", "required": ["lat", "lon"], "additionalProperties": False, "properties": {"lat": {"type": "number", "minimum": -90, "maximum": 90}, "lon": {"type": "number", "minimum": -180, "maximum": 180}}},
        },
    },
}

NOTHING = "array<string>"


def canonical(variant: Column) -> Column:
    return F.to_json(variant)


def _quoted(text: Column) -> Column:
    """A string as a JSON string."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


#: What Spark calls the types of a variant.
TYPES = {"string": "STRING", "integer": "(BIGINT|DECIMAL\\(\\d+,0\\))", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}


def schema_problems(value: Column, schema: dict, path: str = "") -> Column:
    """What is wrong with a JSON value, as `kind:path` strings (null: nothing): type, missing, unknown, enum, range, length, pattern."""
    import json

    kind = F.schema_of_variant(value)
    plain: list[Column] = []
    nested: list[Column] = []
    wanted = schema.get("type", [])
    wanted = [wanted] if isinstance(wanted, str) else wanted
    right = kind.rlike("^(" + "|".join(TYPES[t] for t in wanted) + ")$") if wanted else F.lit(True)
    plain.append(F.when(~right, F.lit(f"type:{path}")))
    if "enum" in schema:
        allowed = [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"]]
        plain.append(F.when(~F.to_json(value).isin(allowed), F.lit(f"enum:{path}")))
    number, text, items = (F.try_variant_get(value, "$", t) for t in ("double", "string", "array<variant>"))
    is_number, is_text, is_array, is_object = (kind.rlike(f"^{TYPES[t]}$") for t in ("number", "string", "array", "object"))
    for name, bad in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x)):
        if name in schema:
            plain.append(F.when(is_number & bad(schema[name]), F.lit(f"range:{path}")))
    for name, held, of, bad in (("minLength", is_text, F.length(text), False), ("maxLength", is_text, F.length(text), True), ("minItems", is_array, F.size(items), False), ("maxItems", is_array, F.size(items), True)):
        if name in schema:
            plain.append(F.when(held & (of > schema[name] if bad else of < schema[name]), F.lit(f"length:{path}")))
    if "pattern" in schema:
        plain.append(F.when(is_text & ~text.rlike(schema["pattern"]), F.lit(f"pattern:{path}")))
    if "items" in schema:
        nested.append(F.when(is_array, F.flatten(F.transform(items, lambda x: schema_problems(x, schema["items"], f"{path}[]")))))
    below = lambda p: f"{path}.{p}" if path else p
    known = schema.get("properties", {})
    for p, inner in sorted(known.items()):
        own = F.try_variant_get(value, "$['" + p.replace("'", "\\'") + "']", "variant")
        there = own.isNotNull()
        if "null" not in inner.get("type", ["null"]):
            there = there & (F.schema_of_variant(own) != "VOID")
        if p in schema.get("required", ()):
            plain.append(F.when(is_object & ~there, F.lit(f"missing:{below(p)}")))
        nested.append(F.when(is_object & there, schema_problems(own, inner, below(p))))
    if schema.get("additionalProperties") is False:
        keys = F.map_keys(F.from_json(F.to_json(value), "map<string,string>"))
        unknown = F.array_except(keys, F.array(*[F.lit(p) for p in sorted(known)]) if known else F.array().cast(NOTHING))
        nested.append(F.when(is_object, F.transform(unknown, lambda k: F.concat(F.lit("unknown:" + (f"{path}." if path else "")), k))))
    none = F.array().cast(NOTHING)
    return F.array_distinct(F.concat(F.array_compact(F.array(*plain)), *[F.coalesce(x, none) for x in nested]))


def argument_problems(name: Column, arguments: Column, tools: Schemas) -> Column:
    """Sorted array of what is wrong with a call's arguments, by the schema of its tool."""
    checks = F.lit(None).cast(NOTHING)
    for tool, schema in sorted(tools.items()):
        checks = F.when(name == tool, F.array_sort(schema_problems(arguments, schema))).otherwise(checks)
    no_object = F.coalesce(~F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(True))
    return F.when(~F.coalesce(name.isin(sorted(tools)), F.lit(False)), F.array(F.lit("unknown_tool"))).when(no_object, F.array(F.lit("arguments_not_object"))).otherwise(checks)


def messages(turns: DataFrame, tools: Schemas | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, part, kind, call_id, linked, level, place, problems, json): one row per message, call and result.

    part numbers the calls of a turn from 0. linked: a call that has a result, or a result that has a call.
    """
    tools = TOOLS if tools is None else tools
    empty = F.array().cast("array<string>")
    plain = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    object_ = F.when(F.col("text").rlike(r"^[ \t\n\r]*\{"), F.try_parse_json("text"))
    parsed = plain.withColumn("v", object_)
    calls = F.when((F.col("role") == "assistant") & F.schema_of_variant(F.try_variant_get("v", "$.tool_calls", "variant")).startswith("ARRAY"), F.try_variant_get("v", "$.tool_calls", "array<struct<id:string,name:string,arguments:variant>>"))
    answers = F.when((F.col("role") == "tool"), F.try_variant_get("v", "$.tool_call_id", "string"))
    parsed = parsed.withColumns({"calls": calls, "answers": answers})
    kind = F.when(F.size("calls") > 0, "call").when(F.col("answers").isNotNull(), "result").otherwise("message")
    parsed = parsed.withColumn("kind", kind)

    said = parsed.where("kind = 'message'").select(
        "conv", "turn", F.lit(0).alias("part"), "kind", F.lit(None).cast("string").alias("call_id"), F.lit(False).alias("linked"), F.lit(0).alias("level"),
        F.col("turn").alias("place"), empty.alias("problems"), F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"),
    )

    made = parsed.where("kind = 'call'").select("conv", "turn", F.posexplode("calls").alias("part", "c"))
    made = made.select("conv", "turn", "part", F.lit("call").alias("kind"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    made = made.withColumn("args", F.coalesce(canonical(F.col("arguments")), F.lit("null")))
    made = made.withColumn("problems", argument_problems(F.col("name"), F.col("arguments"), tools)).withColumn("needs", F.array_distinct(F.regexp_extract_all("args", F.lit(r"\$([A-Za-z0-9_-]+)"), 1)))
    call_json = F.concat(F.lit('{"arguments":'), "args", F.lit(',"id":'), F.coalesce(_quoted(F.col("call_id")), F.lit("null")), F.lit(',"name":'), F.coalesce(_quoted(F.col("name")), F.lit("null")), F.lit(',"role":"assistant"}'))
    made = made.select("conv", "turn", "part", "kind", "call_id", "problems", "needs", call_json.alias("json"))
    given = parsed.where("kind = 'result'").select(
        "conv", "turn", F.lit(0).alias("part"), "kind", F.col("answers").alias("call_id"), empty.alias("problems"), empty.alias("needs"),
        F.concat(F.lit('{"content":'), F.coalesce(canonical(F.try_variant_get("v", "$.content", "variant")), F.lit("null")), F.lit(',"role":"tool","tool_call_id":'), _quoted(F.col("answers")), F.lit("}")).alias("json"),
    )
    nodes = checkpoint(made.unionByName(given))
    return said.unionByName(_linked(nodes))


def _linked(nodes: DataFrame) -> DataFrame:
    """Calls and results with their links, levels and places."""
    here = F.struct("turn", "part")
    named = nodes.where("call_id is not null")
    first = named.where("kind = 'call'").groupBy("conv", "call_id").agg(F.min(here).alias("call_at"))
    answered = named.where("kind = 'result'").groupBy("conv", "call_id").agg(F.min("turn").alias("result_turn"))
    pairs = checkpoint(join_on(first, answered, ["conv", "call_id"], "full"))
    alone = nodes.where("call_id is null").withColumns({"call_at": F.lit(None).cast(pairs.schema["call_at"].dataType), "result_turn": F.lit(None).cast("long")})
    both = join_on(named, pairs, ["conv", "call_id"], "left").unionByName(alone)
    repeated = (F.col("kind") == "call") & F.col("call_at").isNotNull() & (here != F.col("call_at"))
    more = F.array_compact(F.array(
        F.when(F.col("call_id").isNull(), "no_id"), F.when(repeated, "repeated_id"),
        F.when((F.col("kind") == "result") & F.col("call_at").isNull(), "no_call"), F.when((F.col("kind") == "call") & F.col("result_turn").isNull(), "no_result"),
    ))
    linked = F.col("call_at").isNotNull() & F.col("result_turn").isNotNull() & ~repeated
    rows = both.select("conv", "turn", "part", "kind", "call_id", "needs", "json", linked.alias("linked"), F.array_sort(F.concat("problems", more)).alias("problems"))

    # identifiers as one chain: needed results → call → result; an identifier's level is settled when all it needs are
    ids = rows.where("kind = 'call' and linked").select("conv", "call_id", "turn", "needs")
    needs = ids.select("conv", "call_id", F.explode("needs").alias("need"))
    known = ids.select("conv", F.col("call_id").alias("need"))
    needs = checkpoint(join_on(needs, known, ["conv", "need"]).select("conv", "call_id", "need"))
    turns = pairs.where("call_at is not null and result_turn is not null").select("conv", "call_id", F.col("call_at.turn").alias("call_turn"), "result_turn")
    settled = join_on(turns, needs.select("conv", "call_id").distinct(), ["conv", "call_id"], "left_anti")
    settled = settled.select("conv", "call_id", F.lit(0).alias("s_level"), F.col("call_turn").alias("call_place"), F.greatest("call_turn", "result_turn").alias("result_place"))
    if not needs.isEmpty():
        settled = _peel(written(settled), written(needs), turns)
    placed = join_on(rows.where("linked"), settled, ["conv", "call_id"], "left")
    is_call = F.col("kind") == "call"
    level = F.when(is_call, F.col("s_level")).otherwise(F.col("s_level") + 1)
    place = F.coalesce(F.when(is_call, F.col("call_place")).otherwise(F.greatest("turn", "result_place")), F.col("turn"))
    problems = F.when(F.col("s_level").isNull(), F.array_sort(F.array_append("problems", F.lit("circular")))).otherwise(F.col("problems"))
    linked = placed.select("conv", "turn", "part", "kind", "call_id", "linked", level.alias("level"), place.alias("place"), problems.alias("problems"), "json")
    return linked.unionByName(rows.where("not linked").select("conv", "turn", "part", "kind", "call_id", "linked", F.lit(0).alias("level"), F.col("turn").alias("place"), "problems", "json"))


def _peel(settled: DataFrame, needs: DataFrame, turns: DataFrame, gather: int = 16) -> DataFrame:
    """Settles, round by round, the identifiers whose needs are all settled; what stays is circular.

    A round joins what the last one settled with the needs that are open, so each need is met once. Rounds are tables, so that
    Spark knows their sizes.
    """
    found, now, last = [settled], [], settled
    open_ = needs.groupBy("conv", "call_id").agg(F.count("*").alias("left"), F.lit(0).alias("deep"), F.lit(None).cast("long").alias("late"))
    while True:
        have = last.select("conv", F.col("call_id").alias("need"), "s_level", "result_place")
        met = join_on(needs, have, ["conv", "need"]).groupBy("conv", "call_id").agg(F.count("*").alias("n"), F.max("s_level").alias("m_level"), F.max("result_place").alias("m_place"))
        open_ = written(join_on(open_, met, ["conv", "call_id"], "left").select(
            "conv", "call_id", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), F.greatest("deep", "m_level").alias("deep"), F.greatest("late", "m_place").alias("late"),
        ))
        ready = join_on(open_.where("left = 0"), turns, ["conv", "call_id"])
        last = written(ready.select(
            "conv", "call_id", (F.col("deep") + 2).alias("s_level"), F.greatest("call_turn", "late").alias("call_place"),
            F.greatest("call_turn", "late", "result_turn").alias("result_place"),
        ))
        if last.isEmpty():
            break
        open_ = open_.where("left > 0")
        needs = written(join_on(needs, have.select("conv", "need"), ["conv", "need"], "left_anti"))
        now.append(last)
        if len(now) >= gather:  # keeps the plan of the result short
            found, now = [*found, written(reduce(DataFrame.unionByName, now))], []
    return reduce(DataFrame.unionByName, [*found, *now])
