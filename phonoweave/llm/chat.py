"""Chat formatting: links tool calls to their results, orders them, validates arguments, and writes canonical JSON.

A message becomes elements, one row each:
* an assistant text that is JSON with `tool_calls` gives a call for each entry (`id`, `name`, `arguments`, `depends_on`);
* a `tool` text that is JSON with `tool_call_id` gives a result;
* where turns alternate without such JSON, a user turn calls the tool `respond` with the argument `content`, by the
  identifier `turn:<turn>`, and the assistant's next turn is its result;
* anything else is a plain message.

Calls and results are hash-joined by conversation and identifier. The first of each by (turn, place) is linked; later ones are
`duplicate`, calls without a result `unanswered`, results without a call `orphan`; no row is dropped. `order_turn` and
`order_depth` are a topological order of a conversation: sorted by (order_turn, order_depth, turn, place), a result follows
its call and a call follows the results it depends on, without a group ever meeting in one task. Dependencies are peeled a
level at a time; calls on a cycle, or waiting for one, keep their turn and get `depends` = cycle, unknown identifiers `depends` = missing.

Arguments must be a JSON object with the tool's required parameters, none unknown, of the declared types; `problems` lists
what is wrong, sorted. Canonical JSON has sorted keys and no blanks.

Null texts are empty texts, null roles plain messages, null turns come first; rows without a conv_id are linked with nothing; repeated rows stay, with the same link; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoweave.llm.common import Scratch, broadcast_if_small, fresh_path, materialize

CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>, tool_call_id string, content string"
#: The tool that plain user turns call.
RESPOND = ("respond", "content", "string", True)
MOST_TOOLS = 50_000
_NO_STRINGS = "cast(array() as array<string>)"


def elements(messages: DataFrame) -> DataFrame:
    """conv_id, turn, place, role, kind (call, result, message), id, name, arguments (JSON), depends_on, content."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.lower(F.coalesce(F.col("role"), F.lit("")))
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    json = F.when(F.ltrim(F.col("text"), F.lit(" \t\r\n")).startswith("{"), F.from_json("text", CALLS))
    base = base.withColumn("json", json)
    has_calls = F.coalesce((F.col("role") == "assistant") & (F.size("json.tool_calls") > 0), F.lit(False))
    has_result = F.coalesce((F.col("role") == "tool") & F.col("json.tool_call_id").isNotNull(), F.lit(False))
    none = F.lit(None).cast("string")
    no_ids = F.expr(_NO_STRINGS)

    def element(kind: str, id_: Column, name: Column, arguments: Column, depends: Column, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), id_.alias("id"), name.alias("name"), arguments.alias("arguments"), depends.alias("depends_on"), content.alias("content"))

    said = F.to_json(F.struct(F.col("text").alias("content")))
    explicit = F.transform("json.tool_calls", lambda c: element("call", c["id"], c["name"], c["arguments"], F.coalesce(c["depends_on"], no_ids), none))
    chosen = (
        F.when(has_calls, explicit)
        .when(has_result, F.array(element("result", F.col("json.tool_call_id"), none, none, no_ids, F.col("json.content"))))
        .when((F.col("role") == "user") & F.col("turn").isNotNull(), F.array(element("call", F.concat(F.lit("turn:"), F.col("turn")), F.lit(RESPOND[0]), said, no_ids, none)))
        .when((F.col("role") == "assistant") & F.col("turn").isNotNull(), F.array(element("result", F.concat(F.lit("turn:"), F.col("turn") - 1), none, none, no_ids, F.col("text"))))
        .otherwise(F.array(element("message", none, none, none, no_ids, F.col("text"))))
    )
    return base.select("conv_id", "turn", "role", F.posexplode(chosen).alias("place", "e")).select("conv_id", "turn", "place", "role", "e.*")


def _first(rows: DataFrame, name: str) -> DataFrame:
    """The first of each identifier."""
    return rows.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place")).alias(name))


def levels(calls: DataFrame, results: DataFrame, scratch: Scratch) -> DataFrame | None:
    """conv_id, id, ready (turn from which the call can run), depth, depends; None if no call depends on another.

    calls: conv_id, id, turn, depends_on; results: conv_id, id, turn; one row for each identifier. A level writes only the
    calls that it reaches: those whose dependencies are all known by now, and what is known of those that still wait.
    """
    key = ["conv_id", "id"]
    edges = calls.where(F.size("depends_on") > 0).select(*key, F.explode(F.array_distinct("depends_on")).alias("on")).where(F.col("on").isNotNull())
    if edges.isEmpty():
        return None
    edges = scratch.keep(edges.join(calls.select("conv_id", F.col("id").alias("on"), F.lit(True).alias("known")), ["conv_id", "on"], "left"), "chat-edges")
    known = edges.where("known").select(*key, "on")
    waits = known.groupBy(key).agg(F.count("*").alias("waits")).join(calls.select(*key, "turn"), key)
    waits = scratch.keep(waits, "chat-waits")
    ends = results.select("conv_id", F.col("id").alias("on"), F.col("turn").alias("end"))
    first = calls.join(waits, key, "left_anti").join(known.select("conv_id", F.col("on").alias("id")).distinct(), key, "left_semi")
    done = scratch.keep(first.select(*key, F.col("turn").alias("ready"), F.lit(0).alias("depth")), "chat-level")
    placed, pending = None, None
    while not done.isEmpty():
        after = done.withColumnRenamed("id", "on").join(ends, ["conv_id", "on"], "left").select("conv_id", "on", F.greatest("ready", "end").alias("after"), F.col("depth").alias("below"))
        met = known.join(after, ["conv_id", "on"]).select(*key, F.lit(1).cast("long").alias("met"), "after", "below")
        met = (met if pending is None else met.union(pending)).groupBy(key).agg(F.sum("met").alias("met"), F.max("after").alias("after"), F.max("below").alias("below"))
        reached = scratch.keep(met.join(waits, key), "chat-reached")
        pending = reached.where("met < waits").select(*key, "met", "after", "below")
        done = scratch.keep(reached.where("met = waits").select(*key, F.greatest("turn", "after").alias("ready"), (F.col("below") + 2).cast("int").alias("depth")), "chat-level")
        path = scratch.paths["chat-placed"] = scratch.paths.get("chat-placed") or fresh_path(scratch.spark, "chat-placed")
        done.write.mode("append").parquet(path)
        placed = scratch.spark.read.schema(done.schema).parquet(path)
    missing = edges.where("known is null").select(*key, F.lit(True).alias("missing")).distinct()
    state = calls.select(*key, "turn").join(waits.select(*key, F.lit(True).alias("waited")), key, "left").join(missing, key, "left")
    state = state.join(placed, key, "left") if placed is not None else state.withColumns({"ready": F.lit(None).cast("long"), "depth": F.lit(None).cast("int")})
    stuck = F.col("waited").isNotNull() & F.col("ready").isNull()
    depends = F.when(stuck, "cycle").when(F.col("missing"), "missing").otherwise("met")
    return state.select(*key, F.coalesce("ready", "turn").alias("ready"), F.coalesce("depth", F.lit(0)).alias("depth"), depends.alias("depends"))


def problems(arguments: Column, parameters: Column) -> Column:
    """Sorted array of what is wrong with a call's arguments; parameters: map of name to (type, required), null: no such tool."""
    given = F.from_json(arguments, "map<string,variant>")
    kind = lambda v: F.lower(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))
    of = lambda v: F.when(kind(v).isin("bigint", "int", "long", "tinyint", "smallint"), "integer").when(kind(v).isin("decimal", "double", "float"), "number").when(kind(v) == "void", "null").otherwise(kind(v))
    fits = lambda v, t: (of(v) == t) | ((t == "number") & (of(v) == "integer"))
    names = F.map_keys(given)
    absent = F.filter(F.map_keys(F.map_filter(parameters, lambda _, p: p["required"])), lambda n: ~F.array_contains(names, n))
    unknown = F.filter(names, lambda n: ~F.array_contains(F.map_keys(parameters), n))
    # Through entries: a lambda over two maps would look names up in the wrong one when they differ.
    wrong = F.map_keys(F.map_filter(given, lambda n, v: F.array_contains(F.map_keys(parameters), n) & ~fits(v, F.element_at(parameters, n)["type"])))
    mark = lambda word, names: F.transform(names, lambda n: F.concat(F.lit(word), n))
    valid = F.try_parse_json(arguments).isNotNull() & given.isNotNull() & arguments.startswith("{")
    return (
        F.when(parameters.isNull(), F.array(F.lit("unknown tool")))
        .when(~F.coalesce(valid, F.lit(False)), F.array(F.lit("arguments are no object")))
        .otherwise(F.array_sort(F.concat(mark("missing ", absent), mark("unknown ", unknown), mark("type ", wrong))))
    )


def link_calls(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """All elements, linked, ordered, validated and serialised. tools: name, parameter, type, required.

    Types are string, integer, number, boolean, object, array. A tool without parameters has one row with a null parameter.
    """
    with Scratch(messages.sparkSession) as scratch:
        return _linked(messages, tools, scratch)


def _linked(messages: DataFrame, tools: DataFrame, scratch: Scratch) -> DataFrame:
    found = elements(messages)
    with_id = found.where("kind <> 'message' and id is not null")
    calls, results = with_id.where("kind = 'call'"), with_id.where("kind = 'result'")
    first_call, first_result = _first(calls, "first_call"), _first(results, "first_result")
    ahead = levels(
        calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place", "depends_on")).alias("c")).select("conv_id", "id", "c.turn", "c.depends_on"),
        first_result.select("conv_id", "id", "first_result.turn"),
        scratch,
    )
    # The rows are read after this function returns, so what they need of the levels stays.
    ahead = None if ahead is None else materialize(ahead, "chat-levels")
    linked = with_id.join(first_call.hint("shuffle_hash"), ["conv_id", "id"], "left").join(first_result.hint("shuffle_hash"), ["conv_id", "id"], "left")
    if ahead is None:
        linked = linked.withColumns({"ready": F.col("first_call.turn"), "depth": F.lit(0), "depends": F.lit("met")})
    else:
        linked = linked.join(ahead, ["conv_id", "id"], "left")
    own = F.struct("turn", "place")
    is_call = F.col("kind") == "call"
    status = (
        F.when(is_call & (own != F.col("first_call")), "duplicate")
        .when(is_call & F.col("first_result").isNull(), "unanswered")
        .when(~is_call & F.col("first_call").isNull(), "orphan")
        .when(~is_call & (own != F.col("first_result")), "duplicate")
        .otherwise("linked")
    )
    linked = linked.withColumn("status", status).withColumns(
        {
            "order_turn": F.when(is_call, F.coalesce("ready", "turn")).otherwise(F.greatest("turn", "ready")),
            "depends": F.coalesce("depends", F.lit("met")),
            "order_depth": F.coalesce(F.col("depth"), F.lit(0)) + F.when(is_call | (F.col("status") == "orphan"), 0).otherwise(1),
        }
    )
    plain = found.where("kind = 'message' or id is null").withColumns(
        {"status": F.when(F.col("kind") == "message", "message").otherwise("no identifier"), "order_turn": F.col("turn"), "order_depth": F.lit(0), "depends": F.lit("met")}
    )
    keep = ["conv_id", "turn", "place", "role", "kind", "id", "name", "arguments", "content", "status", "order_turn", "order_depth", "depends"]
    rows = linked.select(keep).unionByName(plain.select(keep))

    listed = tools.where("name is not null").groupBy("name", "parameter").agg(F.min("type").alias("type"), F.max("required").alias("required"))
    # A tool without parameters has an empty map.
    named = F.filter(F.collect_list(F.struct("parameter", F.struct("type", "required"))), lambda p: p["parameter"].isNotNull())
    schemas = listed.groupBy("name").agg(F.map_from_entries(named).alias("parameters"))
    rows = rows.join(broadcast_if_small(schemas, MOST_TOOLS), "name", "left")
    rows = rows.withColumn("problems", F.when(is_call, problems(F.coalesce("arguments", F.lit("")), F.col("parameters"))).otherwise(F.expr(_NO_STRINGS)))
    canonical = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct(F.coalesce("arguments", F.lit("")).alias("raw"))))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    own_id = F.when(F.col("id").isNull(), "null").otherwise(quoted(F.col("id")))
    json = (
        F.when(is_call, F.concat(F.lit('{"arguments":'), canonical, F.lit(',"id":'), own_id, F.lit(',"name":'), quoted(F.col("name")), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"type":"call"}')))
        .when(F.col("kind") == "result", F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"id":'), quoted(F.col("id")), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"type":"result"}')))
        .otherwise(F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"type":"message"}')))
    )
    return rows.select("conv_id", "turn", "place", "kind", "id", "status", "order_turn", "order_depth", "depends", F.array_join("problems", "; ").alias("problems"), json.alias("json"))
