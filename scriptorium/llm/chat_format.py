"""Chat formatting by tool-call linking, in DataFrame functions alone.

A turn whose text is a JSON object may carry tool calls, each in one of two forms,
    {"id": ..., "name": ..., "arguments": {...}}
    {"id": ..., "type": "function", "function": {"name": ..., "arguments": "{...}"}},
in its list `tool_calls`; a turn of role `tool` is a result, {"tool_call_id": ...,
"content": ...}.  Calls and results are hash-joined by conversation and
identifier; a result is ordered after its call, whatever its own turn says;
arguments are validated against the tools' schemas; every turn is serialised as
canonical JSON (sorted keys, no blanks, calls in the first form, arguments as
objects), with all keys that it came with.  The work is by turn: a conversation is
never gathered, so its length does not matter, and order is given as keys to sort
by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schemas of tools: argument to type, with "!" for a required one.
TOOLS = {
    "search": {"query": "string!", "limit": "integer"},
    "calculate": {"expression": "string!"},
    "lookup": {"key": "string!", "exact": "boolean", "weight": "number"},
}
_KINDS = {"string": "^STRING", "integer": "^(BIGINT|INT|SMALLINT|TINYINT)", "number": "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT"}
_CALL = "struct<id:string,name:string,arguments:variant,held:variant>"
_OBJECT = "map<string,variant>"


def _object(pairs: dict[str, Column], rest: Column) -> Column:
    """A variant object of `rest`, a map of variants, with these keys set anew; keys sorted."""
    names = F.array(*[F.lit(k) for k in sorted(pairs)])
    held = F.map_filter(F.coalesce(rest, F.create_map().cast(_OBJECT)), lambda k, _: ~F.array_contains(names, k))
    null = F.parse_json(F.lit("null"))
    return F.to_variant_object(F.map_concat(held, F.create_map(*[x for k, v in sorted(pairs.items()) for x in (F.lit(k), F.coalesce(v, null))])))


def _call(c: Column) -> Column:
    """struct<id, name, arguments, held> of one call in either form; held: the canonical call."""
    of = lambda path, kind: F.try_variant_get(c, path, kind)
    told = F.coalesce(of("$.function.arguments", "variant"), of("$.arguments", "variant"))
    text = F.when(F.schema_of_variant(told) == "STRING", F.try_variant_get(told, "$", "string"))
    args = F.coalesce(F.try_parse_json(text), told)
    id_, name = of("$.id", "string"), F.coalesce(of("$.function.name", "string"), of("$.name", "string"))
    both = F.map_filter(F.coalesce(of("$", _OBJECT), F.create_map().cast(_OBJECT)), lambda k, _: k != "function")
    inner = F.coalesce(of("$.function", _OBJECT), F.create_map().cast(_OBJECT))
    # keys of both are the call's own
    rest = F.map_concat(both, F.map_filter(inner, lambda k, _: ~F.map_contains_key(both, k)))
    held = _object({"arguments": args, "id": F.coalesce(of("$.id", "variant"), F.parse_json(F.lit("null"))), "name": _text(name)}, rest)
    return F.struct(id_.alias("id"), name.alias("name"), args.alias("arguments"), held.alias("held"))


def _text(value: Column) -> Column:
    """A string as a variant; null for null."""
    return F.try_variant_get(F.to_variant_object(F.struct(value.alias("x"))), "$.x", "variant")


def _problems(call: Column, tools: dict[str, dict[str, str]]) -> Column:
    """Sorted problems of a call's arguments, comma-joined; empty for a valid call."""
    name, args = call["name"], call["arguments"]
    keys = F.coalesce(F.json_object_keys(F.to_json(args)), F.array().cast("array<string>"))
    found = F.when(F.lit(False), F.lit(""))
    for tool, schema in sorted(tools.items()):
        parts = [F.transform(F.array_except(keys, F.array(*map(F.lit, sorted(schema)))), lambda k: F.concat(F.lit("unknown:"), k))]
        for arg, kind in sorted(schema.items()):
            there = F.array_contains(keys, arg)
            right = F.schema_of_variant(F.try_variant_get(args, f"$.{arg}", "variant")).rlike(_KINDS[kind.rstrip("!")])
            one = lambda text: F.array(F.lit(text))
            none = F.array().cast("array<string>")
            parts.append(F.when(there & ~F.coalesce(right, F.lit(False)), one(f"type:{arg}")).when(~there & F.lit(kind.endswith("!")), one(f"missing:{arg}")).otherwise(none))
        found = found.when(name == tool, F.array_join(F.sort_array(F.concat(*parts)), ","))
    return found.otherwise(F.lit("unknown tool"))


def format_chats(df: DataFrame, tools: dict[str, dict[str, str]] = TOOLS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each turn: (conv_id, turn, order_turn, order_step, role, kind, n_calls, n_linked, n_invalid, problems, call_id, linked, json).

    Sorting by (conv_id, order_turn, order_step, turn) is a topological order.
    kind: message, call (a turn with tool calls), result.  n_linked: calls of the
    turn that have a result; linked: whether a result has a call.  A text that is
    no JSON object, or one without calls in a turn of another role than tool, null
    or empty is a plain message with that text as content, "" for null; a null
    content of a call or result stays null; keys that are not known here are
    kept; arguments that are a string of JSON are read, other strings are kept and
    lack all keys.  A role is trimmed and lower-cased, null or blank becomes
    `unknown`; of calls with one identifier in a conversation the first turn's
    counts; repeated turns are rows each; a null identifier or conversation links
    nothing; other columns play no part; an empty table gives no rows.
    """
    body = df[text].cast("string")
    rows = df.select(df[conv].alias("conv_id"), df[turn].cast("bigint").alias("turn"), F.coalesce(F.nullif(F.lower(F.trim(df[role])), F.lit("")), F.lit("unknown")).alias("role"), body.alias("text"))
    rows = rows.withColumn("v", F.when(F.ltrim(F.col("text")).startswith("{"), F.try_parse_json("text")))
    none = F.array().cast(f"array<{_CALL}>")
    listed = F.filter(F.try_variant_get("v", "$.tool_calls", "array<variant>"), lambda c: F.coalesce(F.schema_of_variant(c).startswith("OBJECT"), F.lit(False)))
    rows = rows.withColumn("calls", F.when(F.col("role") != "tool", F.transform(listed, _call)))
    rows = rows.withColumn("calls", F.coalesce("calls", none))
    rows = rows.withColumn("call_id", F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string")))
    made = rows.filter(F.size("calls") > 0).select("conv_id", "turn", F.explode("calls.id").alias("call_id"))
    made = made.groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn"))
    got = rows.filter("call_id is not null").select("conv_id", "call_id").distinct()
    # results to calls, and back to the turns that called
    answered = made.join(got, ["conv_id", "call_id"]).groupBy("conv_id", F.col("call_turn").alias("turn")).agg(F.collect_set("call_id").alias("answered"))
    plain = rows.filter("size(calls) = 0 and call_id is null").select("*", F.lit(None).cast("bigint").alias("call_turn"), F.lit(None).cast("array<string>").alias("answered"))
    results = rows.filter("call_id is not null").join(made, ["conv_id", "call_id"], "left").select(*rows.columns, "call_turn", F.lit(None).cast("array<string>").alias("answered"))
    callers = rows.filter("size(calls) > 0").join(answered, ["conv_id", "turn"], "left").select(*rows.columns, F.lit(None).cast("bigint").alias("call_turn"), "answered")
    out = plain.union(results).union(callers)
    bad = F.filter(F.transform("calls", lambda c: F.struct(c["id"].alias("id"), _problems(c, tools).alias("problems"))), lambda p: p["problems"] != "")
    keys = F.try_variant_get("v", "$", _OBJECT)
    shared = {"content": F.try_variant_get("v", "$.content", "variant"), "role": _text(F.col("role"))}
    # a list of variants is written as JSON and read again: objects of a list keep their sorted keys
    called = F.parse_json(F.concat(F.lit("["), F.array_join(F.transform("calls", lambda c: F.to_json(c["held"])), ","), F.lit("]")))
    return (
        out.withColumn("kind", F.when(F.size("calls") > 0, "call").when(F.col("call_id").isNotNull(), "result").otherwise("message"))
        .withColumn("order_turn", F.greatest("turn", F.coalesce("call_turn", "turn")))
        .withColumn("order_step", (F.col("kind") == "result").cast("int"))
        .withColumn("n_calls", F.size("calls"))
        .withColumn("n_linked", F.size(F.filter("calls", lambda c: F.coalesce(F.array_contains("answered", c["id"]), F.lit(False)))))
        .withColumn("bad", bad)
        .withColumn("n_invalid", F.size("bad"))
        .withColumn("problems", F.array_join(F.transform("bad", lambda p: F.concat_ws("=", p["id"], p["problems"])), ";"))
        .withColumn("linked", F.col("call_turn").isNotNull())
        .withColumn(
            "json",
            F.when(F.col("kind") == "call", F.to_json(_object(shared | {"tool_calls": called}, keys)))
            .when(F.col("kind") == "result", F.to_json(_object(shared | {"tool_call_id": F.try_variant_get("v", "$.tool_call_id", "variant")}, keys)))
            .otherwise(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("content"), F.col("role")))),
        )
        .select("conv_id", "turn", "order_turn", "order_step", "role", "kind", "n_calls", "n_linked", "n_invalid", "problems", "call_id", "linked", "json")
    )


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, 2, F.length(listed) - 2)


def as_tool_chats(conversations: DataFrame) -> DataFrame:
    """Conversations as tool traffic: the input of the registered query, as its table holds plain messages only.

    A user's turn becomes a turn with one call, valid or not by its number and
    length, in the flat or the nested form; an assistant's turn becomes the result
    of the turn before, an orphan where that is no user's; others stay.
    """
    said, way = F.coalesce("text", F.lit("")), F.pmod(F.col("turn") + F.length(F.coalesce("text", F.lit(""))), F.lit(4))
    args = (
        F.when(way == 0, F.to_json(F.struct(F.length(said).alias("limit"), said.alias("query"))))
        .when(way == 1, F.to_json(F.struct(F.lit("no").alias("limit"), said.alias("query"))))
        .when(way == 2, F.to_json(F.struct(F.lit(True).alias("exact"))))
        .otherwise(F.lit("{}"))
    )
    name = F.when(way < 2, "search").when(way == 2, "lookup").otherwise("browse")
    id_ = F.concat(F.lit("c"), F.col("turn").cast("string"))
    flat = F.concat(F.lit('{"content":'), _quoted(said), F.lit(',"tool_calls":[{"id":"'), id_, F.lit('","name":"'), name, F.lit('","arguments":'), args, F.lit("}]}"))
    function = F.to_json(F.struct(name.alias("name"), args.alias("arguments")))
    nested = F.concat(F.lit('{"content":null,"tool_calls":[{"id":"'), id_, F.lit('","type":"function","function":'), function, F.lit("}]}"))
    result = F.to_json(F.struct(F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("tool_call_id"), said.alias("content")))
    role = F.lower(F.trim("role"))
    text = F.when(role == "user", F.when(F.col("turn") % 4 < 2, flat).otherwise(nested)).when(role == "assistant", result).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", F.when(role == "user", "assistant").when(role == "assistant", "tool").otherwise(F.col("role")).alias("role"), text.alias("text"))


def oracle() -> str:
    """DuckDB SQL for format_chats over as_tool_chats of conversations, from conversations themselves."""
    said = "coalesce(text, '')"
    way = f"(((turn + length({said})) % 4) + 4) % 4"
    args = f"CASE {way} WHEN 0 THEN json_object('limit', length({said}), 'query', {said}) WHEN 1 THEN json_object('limit', 'no', 'query', {said}) WHEN 2 THEN json_object('exact', true) ELSE json_object() END"
    name = f"CASE {way} WHEN 0 THEN 'search' WHEN 1 THEN 'search' WHEN 2 THEN 'lookup' ELSE 'browse' END"
    problems = f"CASE {way} WHEN 0 THEN '' WHEN 1 THEN '=type:limit' WHEN 2 THEN '=missing:key' ELSE '=unknown tool' END"
    return (
        "WITH r AS (SELECT *, coalesce(nullif(lower(trim(role)), ''), 'unknown') AS said_by FROM conversations), "
        f"u AS (SELECT conv_id, turn, 'c' || CAST(turn AS VARCHAR) AS id, {name} AS name, {args} AS args, {problems} AS bad, text FROM r WHERE said_by = 'user'), "
        "calls AS (SELECT DISTINCT conv_id, turn FROM u), results AS (SELECT DISTINCT conv_id, turn - 1 AS turn FROM r WHERE said_by = 'assistant'), "
        "made AS (SELECT u.conv_id, u.turn, u.turn AS order_turn, CAST(0 AS INTEGER) AS order_step, 'assistant' AS role, 'call' AS kind, CAST(1 AS INTEGER) AS n_calls, CAST(CASE WHEN s.turn IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_linked, "
        "CAST(CASE WHEN bad = '' THEN 0 ELSE 1 END AS INTEGER) AS n_invalid, CASE WHEN bad = '' THEN '' ELSE id || bad END AS problems, CAST(NULL AS VARCHAR) AS call_id, false AS linked, "
        f"CAST(CASE WHEN u.turn % 4 < 2 THEN json_object('content', {said}, 'role', 'assistant', 'tool_calls', json_array(json_object('arguments', args, 'id', id, 'name', name))) "
        "ELSE json_object('content', NULL, 'role', 'assistant', 'tool_calls', json_array(json_object('arguments', args, 'id', id, 'name', name, 'type', 'function'))) END AS VARCHAR) AS json "
        "FROM u LEFT JOIN results s ON s.conv_id = u.conv_id AND s.turn = u.turn), "
        "got AS (SELECT r.conv_id, r.turn, greatest(r.turn, coalesce(c.turn, r.turn)) AS order_turn, CAST(1 AS INTEGER) AS order_step, 'tool' AS role, 'result' AS kind, CAST(0 AS INTEGER) AS n_calls, CAST(0 AS INTEGER) AS n_linked, CAST(0 AS INTEGER) AS n_invalid, '' AS problems, "
        f"'c' || CAST(r.turn - 1 AS VARCHAR) AS call_id, c.turn IS NOT NULL AS linked, CAST(json_object('content', {said}, 'role', 'tool', 'tool_call_id', 'c' || CAST(r.turn - 1 AS VARCHAR)) AS VARCHAR) AS json "
        "FROM r LEFT JOIN calls c ON c.conv_id = r.conv_id AND c.turn = r.turn - 1 WHERE said_by = 'assistant'), "
        "rest AS (SELECT conv_id, turn, turn AS order_turn, CAST(0 AS INTEGER) AS order_step, said_by AS role, 'message' AS kind, CAST(0 AS INTEGER) AS n_calls, CAST(0 AS INTEGER) AS n_linked, CAST(0 AS INTEGER) AS n_invalid, '' AS problems, "
        f"CAST(NULL AS VARCHAR) AS call_id, false AS linked, CAST(json_object('content', {said}, 'role', said_by) AS VARCHAR) AS json FROM r WHERE said_by NOT IN ('user', 'assistant')) "
        "SELECT * FROM made UNION ALL SELECT * FROM got UNION ALL SELECT * FROM rest"
    )
