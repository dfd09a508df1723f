"""Chat formatting with tool calls, in Spark SQL functions only.

Assistant texts may hold calls, ``<tool_call>{"id":..,"name":..,"arguments":{..}}</tool_call>``;
a message of role ``tool`` is the result of one, ``{"tool_call_id":..,"content":..}``.
Results meet calls in a hash join on conversation and identifier.  Messages get a
topological order: that of turns, in which a result that stands before its call
moves behind it; a call never moves, and calls don't wait for each other.
Arguments are validated against the tools' JSON schemas, to any depth of objects
and arrays: the schemas are few and known when a plan is made, so each becomes
one Column expression.  Every message becomes one line of canonical JSON: sorted
keys, no spaces, normal numbers.

Of a schema, ``type`` (one or several), ``enum``, ``properties``, ``required``,
``additionalProperties`` (false), ``items``, ``minimum``, ``maximum``,
``minLength``, ``maxLength``, ``minItems`` and ``maxItems`` count.  Errors name
the place: ``missing a.b``, ``unknown a.c``, ``type a.list[]``, ``enum a``, ``range a``,
``length a``; errors of an array's items are told once.

The result has one row for each message with its place (order_turn, order_phase,
order_call, turn), so a conversation of any length never has to fit a task; sort
by conversation and place to get transcripts.

Defined results: the first call (by turn, then place in the text) of an
identifier gets all its results, of which the first by turn is ``result`` and
the rest are ``repeated``; a result without call is an ``orphan``; calls that
can't be read (an object with a key twice is one of these) or lack a name or id are
invalid and stay in the text; identifiers that are numbers count as their text; results
without a turn are ``repeated`` ones at their call's place; rows without conv_id link with nothing; a message's own calls stay with it, whatever
rows share its conv_id and turn; null texts have null content; of two tools with
one name the first schema in order of text counts; rows that repeat stay; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CALL = r"(?s)<tool_call>(.*?)</tool_call>"

#: JSON schemas of the arguments of each tool.
TOOLS: dict[str, dict] = {
    "calculate": {"type": "object", "additionalProperties": False, "required": ["expression"], "properties": {"expression": {"type": "string"}, "digits": {"type": "integer", "minimum": 0, "maximum": 40}}},
    "fetch": {"type": "object", "additionalProperties": False, "required": ["url"], "properties": {"url": {"type": "string", "minLength": 1}, "headers": {"type": "object"}, "timeout": {"type": "number", "minimum": 0}}},
    "search": {
        "type": "object", "additionalProperties": False, "required": ["query"],
        "properties": {
            "query": {"type": "string"}, "limit": {"type": "integer"}, "sites": {"type": "array", "items": {"type": "string"}}, "exact": {"type": "boolean"},
            "filter": {"type": "object", "additionalProperties": False, "required": ["field"], "properties": {"field": {"type": "string", "enum": ["title", "body"]}, "within": {"type": "array", "maxItems": 8, "items": {"type": "object", "required": ["from"], "properties": {"from": {"type": "integer"}, "to": {"type": ["integer", "null"]}}}}}},
        },
    },
}
MOST_TOOLS = 1000


def tool_table(spark: SparkSession, tools: dict[str, dict] | None = None) -> DataFrame:
    """(tool, schema) from a dictionary of JSON schemas."""
    rows = [F.struct(F.lit(name).alias("tool"), F.lit(json.dumps(schema)).alias("schema")) for name, schema in (TOOLS if tools is None else tools).items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.tool", "t.schema") if rows else spark.createDataFrame([], "tool string, schema string")


def schemas_of(tools: DataFrame) -> dict[str, dict]:
    """The schemas of a table (tool, schema as JSON), which may have up to ``MOST_TOOLS`` rows."""
    rows = tools.select("tool", "schema").filter("tool is not null and schema is not null").distinct().orderBy("tool", "schema").limit(MOST_TOOLS + 1).collect()
    if len(rows) > MOST_TOOLS:
        raise ValueError(f"over {MOST_TOOLS} tools")
    out: dict[str, dict] = {}
    for r in rows:
        out.setdefault(r["tool"], json.loads(r["schema"]))
    return out


def _is(kind: str, value: Column) -> Column:
    """Whether a variant is of a JSON schema type."""
    found = F.schema_of_variant(value)
    whole = found.isin("BIGINT") | found.rlike(r"^DECIMAL\(\d+,0\)$")
    return {
        "string": found == "STRING", "integer": whole, "number": whole | found.startswith("DECIMAL") | found.isin("DOUBLE", "FLOAT"),
        "boolean": found == "BOOLEAN", "array": found.startswith("ARRAY"), "object": found.startswith("OBJECT"), "null": found == "VOID",
    }[kind]


_NONE = "array<string>"


def _told(bad: Column, text: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(text))).otherwise(F.array().cast(_NONE))


def problems(schema: dict, value: Column, path: str = "") -> Column:
    """array<string>: what is wrong with a variant by a schema, itself first and then its parts in the schema's order."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    as_type = lambda t: F.try_variant_get(value, "$", t)
    dot = f"{path}." if path else ""
    own = [_told(F.to_json(value).isin([json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in schema["enum"]]) == F.lit(False), f"enum {path}")] if "enum" in schema else []
    for key, over in (("minimum", lambda v, b: v < b), ("maximum", lambda v, b: v > b)):
        if key in schema:
            own.append(_told(_is("number", value) & over(as_type("double"), F.lit(float(schema[key]))), f"range {path}"))
    sizes = (("minLength", "string", lambda: F.length(as_type("string"))), ("maxLength", "string", lambda: F.length(as_type("string"))), ("minItems", "array", lambda: F.size(as_type("array<variant>"))), ("maxItems", "array", lambda: F.size(as_type("array<variant>"))))
    for key, kind, size in sizes:
        if key in schema:
            own.append(_told(_is(kind, value) & (size() < schema[key] if key.startswith("min") else size() > schema[key]), f"length {path}"))
    parts = schema.get("properties", {})
    if parts or schema.get("required") or schema.get("additionalProperties") is False:
        given = as_type("map<string,variant>")
        object_ = F.coalesce(_is("object", value), F.lit(False))
        has = lambda n: F.array_contains(F.map_keys(given), n)
        inner = [_told(~has(n), f"missing {dot}{n}") for n in schema.get("required", [])]
        if schema.get("additionalProperties") is False:
            others = F.array_sort(F.array_except(F.map_keys(given), F.array(*map(F.lit, parts)).cast(_NONE)))
            inner.append(F.transform(others, lambda n: F.concat(F.lit(f"unknown {dot}"), n)))
        inner += [F.when(has(n), problems(part, F.element_at(given, n), f"{dot}{n}")).otherwise(F.array().cast(_NONE)) for n, part in parts.items()]
        own.append(F.when(object_, F.concat(*inner)).otherwise(F.array().cast(_NONE)))
    if "items" in schema:
        each = F.array_distinct(F.flatten(F.transform(as_type("array<variant>"), lambda v: problems(schema["items"], v, f"{path}[]"))))
        own.append(F.when(F.coalesce(_is("array", value), F.lit(False)), each).otherwise(F.array().cast(_NONE)))
    rest = F.concat(*own) if own else F.array().cast(_NONE)
    if not kinds:
        return rest
    fits = _is(kinds[0], value)
    for k in kinds[1:]:
        fits = fits | _is(k, value)
    return F.when(F.coalesce(fits, F.lit(False)), rest).otherwise(F.array(F.lit(f"type {path}")))


def with_calls(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """``messages`` with ``calls``, an array of (raw, call_id, name, arguments, valid, errors) made within the row; null for other roles."""
    known = schemas_of(tools)

    def read(raw: Column) -> Column:
        v = F.try_parse_json(raw)
        text = lambda n: F.try_variant_get(v, f"$.{n}", "string").alias(n)
        return F.struct(raw.alias("raw"), text("id"), text("name"), F.try_variant_get(v, "$.arguments", "variant").alias("given"))

    def judged(c: Column) -> Column:
        of_tool = F.array(F.lit("no such tool"))
        for name, schema in known.items():
            of_tool = F.when(c["name"] == name, problems(schema, c["given"])).otherwise(of_tool)
        told = F.when(c["name"].isin(list(known)) & ~F.coalesce(_is("object", c["given"]), F.lit(False)), F.array(F.lit("no arguments"))).otherwise(of_tool)
        errors = F.when(c["id"].isNull() | c["name"].isNull(), F.array(F.lit("unreadable"))).otherwise(told)
        return F.struct(c["raw"].alias("raw"), c["id"].alias("call_id"), c["name"].alias("name"), F.to_json(c["given"]).alias("arguments"), errors.alias("errors"))

    found = F.when(F.col("role") == "assistant", F.regexp_extract_all("text", F.lit(CALL), F.lit(1)))
    done = F.transform(F.transform(found, read), judged)
    calls = F.transform(done, lambda c: F.struct(*[c[n].alias(n) for n in ("raw", "call_id", "name", "arguments")], (F.size(c["errors"]) == 0).alias("valid"), c["errors"].alias("errors")))
    return messages.withColumn("calls", calls)


def first_calls(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, call_turn, order_call): where each identifier is called first; arguments are not looked at."""
    raw = F.posexplode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("k", "raw")
    each = messages.filter((F.col("role") == "assistant") & F.col("text").contains("<tool_call>")).select("conv_id", "turn", raw)
    each = each.withColumn("call_id", F.try_variant_get(F.try_parse_json("raw"), "$.id", "string")).filter("call_id is not null")
    first = each.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "k")).alias("at"))
    return first.select("conv_id", "call_id", F.col("at.turn").alias("call_turn"), F.col("at.k").alias("order_call"))


def link(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row for each message: conv_id, turn, role, state, call_id, call_turn, order_turn, order_phase, order_call, n_calls, n_valid, line."""
    own = messages.select("conv_id", "turn", "role", "text")
    first = first_calls(own)

    is_result = F.coalesce(F.col("role") == "tool", F.lit(False))
    parsed = F.when(is_result, F.try_parse_json("text"))
    results = own.filter(is_result).withColumn("v", parsed).withColumn("call_id", F.try_variant_get("v", "$.tool_call_id", "string")).withColumn("content", F.coalesce(F.try_variant_get("v", "$.content", "string"), F.to_json(F.try_variant_get("v", "$.content", "variant")), F.col("text"))).drop("v")
    linked = results.join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    earliest = results.filter("call_id is not null and conv_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("first_turn"))
    linked = linked.join(earliest.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    state = F.when(F.col("call_turn").isNull(), "orphan").when(F.col("turn") == F.col("first_turn"), "result").otherwise("repeated")
    moved = F.greatest("turn", "call_turn")
    linked = linked.select("conv_id", "turn", "role", "content", state.alias("state"), "call_id", "call_turn", moved.alias("order_turn"), F.when(F.col("call_turn") >= F.col("turn"), 1).otherwise(0).alias("order_phase"), F.coalesce("order_call", F.lit(0)).alias("order_call"), F.lit(0).alias("n_calls"), F.lit(0).alias("n_valid"), F.lit(None).cast("array<struct<arguments:string,errors:array<string>,id:string,name:string,valid:boolean>>").alias("tool_calls"))

    # Only messages with a call mark take part; their calls are made within the row, so no key has to tell messages apart.
    marked = F.coalesce((F.col("role") == "assistant") & F.col("text").contains("<tool_call>"), F.lit(False))
    talk = with_calls(own.filter(~is_result & marked), tools)
    talk = talk.withColumn("tool_calls", F.transform("calls", lambda x: F.struct(x["arguments"].alias("arguments"), x["errors"].alias("errors"), x["call_id"].alias("id"), x["name"].alias("name"), x["valid"].alias("valid"))))
    # Texts between calls and, where a call was not read, the call as it stands.
    between = F.split("text", CALL, -1)
    unread = lambda c: F.when(c["call_id"].isNull() | c["name"].isNull(), F.concat(F.lit("<tool_call>"), c["raw"], F.lit("</tool_call>"))).otherwise("")
    talk = talk.withColumn("between", between)
    cleaned = F.trim(F.concat(F.get("between", F.lit(0)), F.array_join(F.transform("calls", lambda c, k: F.concat(unread(c), F.get("between", k + 1))), "")))
    plain = ["conv_id", "turn", "role"]
    place = [F.lit(None).cast("string").alias("call_id"), F.lit(None).cast(messages.schema["turn"].dataType).alias("call_turn"), F.col("turn").alias("order_turn"), F.lit(0).alias("order_phase"), F.lit(0).alias("order_call")]
    talk = talk.select(*plain, cleaned.alias("content"), F.lit("call").alias("state"), *place, F.coalesce(F.size("tool_calls"), F.lit(0)).alias("n_calls"), F.size(F.filter(F.coalesce("tool_calls", F.array().cast(linked.schema["tool_calls"].dataType)), lambda x: x["valid"])).alias("n_valid"), "tool_calls")
    rest = own.filter(~is_result & ~marked).select(*plain, F.col("text").alias("content"), F.lit("plain").alias("state"), *place, F.lit(0).alias("n_calls"), F.lit(0).alias("n_valid"), F.lit(None).cast(linked.schema["tool_calls"].dataType).alias("tool_calls"))
    order = rest.columns
    every = rest.unionByName(talk).unionByName(linked.select(*order))
    return every.withColumn("line", _line()).drop("content", "tool_calls")


def _text(value: str | Column) -> Column:
    """A JSON string, or null."""
    value = F.col(value) if isinstance(value, str) else value
    boxed = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(boxed, F.lit(2), F.length(boxed) - 2))


def _line() -> Column:
    """Canonical JSON of the message; keys in order, absent ones left out."""
    one = lambda c: F.concat(F.lit('{"arguments":'), F.coalesce(c["arguments"], F.lit("null")), F.lit(',"errors":'), F.to_json(c["errors"]), F.lit(',"id":'), _text(c["id"]), F.lit(',"name":'), _text(c["name"]), F.lit(',"valid":'), c["valid"].cast("string"), F.lit("}"))
    calls = F.when(F.size("tool_calls") > 0, F.concat(F.lit(',"tool_calls":['), F.array_join(F.transform("tool_calls", one), ","), F.lit("]"))).otherwise("")
    answers = F.when(F.col("call_id").isNotNull(), F.concat(F.lit(',"tool_call_id":'), _text("call_id"))).otherwise("")
    return F.concat(F.lit('{"content":'), _text("content"), F.lit(',"role":'), _text("role"), answers, calls, F.lit("}"))
