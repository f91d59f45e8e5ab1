"""Chat formatting: tool calls linked to their results, checked and serialised, in DataFrame operations only.

A turn's text may be a JSON object: {"content", "tool_calls": [{"id", "name",
"arguments"}]} (or with "function": {"name", "arguments"}) makes calls, and
{"tool_call_id", "content"} is a result. Any other text is plain content.
Calls and results meet in a hash join on (conv_id, call id); messages are put
in topological order, every result behind the message that makes its call, by
pointer jumping along the links; arguments are checked against a
table of parameters, given or inferred from the calls; every message becomes
one line of canonical JSON, with the further fields of a call or result.
Messages stay rows, so a conversation of any length is never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranks
from .textkit import Tables

_SHAPE = "struct<content:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>>>"
#: JSON schema types, and the types that a parsed value may have for each.
_TYPES = {
    "string": ["STRING"],
    "integer": ["BIGINT"],
    "number": ["BIGINT", "DOUBLE", "DECIMAL"],
    "boolean": ["BOOLEAN"],
    "array": ["ARRAY"],
    "object": ["OBJECT"],
    "null": ["VOID"],
}


#: Fields of a message that are written from columns of their own.
_OWN = ("content", "role", "tool_call_id", "tool_calls")


def messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, calls, result_of, more (further fields, as JSON), message, a key of each row, and beyond (an argument is a number beyond a double).

    Calls without an id get one from their place. Rows that are equal share a key.
    """
    parsed = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("_json", F.when(F.ltrim("text").startswith("{"), F.from_json("text", _SHAPE)))
    made = F.transform(
        F.col("_json.tool_calls"),
        lambda c, i: F.struct(
            F.coalesce(c["id"], F.concat(F.lit("call_"), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("_"), i.cast("string"))).alias("id"),
            F.coalesce(c["name"], c["function"]["name"], F.lit("")).alias("name"),
            F.coalesce(c["arguments"], c["function"]["arguments"], F.lit("{}")).alias("arguments"),
        ),
    )
    linked = F.col("_json.tool_calls").isNotNull() | F.col("_json.tool_call_id").isNotNull()
    fields = F.map_filter(F.when(linked, F.from_json("text", "map<string,variant>")), lambda k, v: ~k.isin(*_OWN))
    more = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("json")))
    return parsed.select(
        "conv_id",
        "turn",
        "role",
        F.when(linked, F.coalesce("_json.content", F.lit(""))).otherwise(F.col("text")).alias("content"),
        F.coalesce(made, F.array().cast("array<struct<id:string,name:string,arguments:string>>")).alias("calls"),
        F.col("_json.tool_call_id").alias("result_of"),
        F.coalesce(more, F.array().cast("array<struct<key:string,json:string>>")).alias("more"),
        F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text")), 256).alias("message"),
        # parsing turns a number beyond a double into a word that the text does not have
        (F.coalesce(F.size(F.split(F.array_join(F.transform(made, lambda c: c["arguments"]), ","), "Infinity")), F.lit(1)) > F.size(F.split("text", "Infinity"))).alias("beyond"),
    )


def calls(rows: DataFrame) -> DataFrame:
    """One row for each call: conv_id, message, call_turn, call_no, call_id, tool, arguments as a variant (null if not JSON, or if a name comes twice)."""
    return (
        rows.where(F.size("calls") > 0)
        .select("conv_id", "message", F.col("turn").alias("call_turn"), F.posexplode("calls").alias("call_no", "call"))
        .select("conv_id", "message", "call_turn", "call_no", F.col("call.id").alias("call_id"), F.col("call.name").alias("tool"), F.try_parse_json("call.arguments").alias("args"))
    )


def _given(made: DataFrame) -> DataFrame:
    """(message, call_no, tool, param, kind): the arguments of calls whose arguments are an object."""
    objects = made.where(F.coalesce(F.schema_of_variant("args").startswith("OBJECT"), F.lit(False)))
    given = made.sparkSession.sql("SELECT message, call_no, tool, e.key AS param, e.value AS value FROM {objects}, LATERAL variant_explode(args) AS e", objects=objects)
    return given.select("message", "call_no", "tool", "param", F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0).alias("kind"))


def inferred_schemas(conversations: DataFrame) -> DataFrame:
    """(tool, param, type, required) from the calls themselves: the type that most of a parameter's values have (ties: the
    first by name), required if more than half of the tool's calls give it; and one row without a param for each tool that is called."""
    made = calls(messages(conversations))
    total = made.groupBy("tool").agg(F.count("*").alias("calls"))
    names = F.create_map(*[F.lit(x) for k in ("BOOLEAN", "ARRAY", "OBJECT", "VOID", "STRING") for x in (k, next(n for n, kinds in _TYPES.items() if k in kinds))])
    # whole numbers among fractions are numbers
    typed = _given(made).withColumn("type", F.coalesce(names[F.col("kind")], F.when(F.col("kind") == "BIGINT", "integer").otherwise("number")))
    counts = typed.groupBy("tool", "param", "type").agg(F.count("*").alias("n"))
    each = counts.groupBy("tool", "param").agg(F.sum("n").alias("n"), F.min_by("type", F.struct(-F.col("n"), "type")).alias("type"), F.max(F.col("type") == "number").alias("_fractions"))
    kind = F.when((F.col("type") == "integer") & F.col("_fractions"), "number").otherwise(F.col("type"))
    known = each.join(total, "tool").select("tool", "param", kind.alias("type"), (2 * F.col("n") > F.col("calls")).alias("required"))
    # a tool that no call gives a parameter is known all the same
    return known.union(total.select("tool", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)))


def check_arguments(made: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds `problems` (sorted texts, empty if valid) to calls, by schemas (tool, param, type, required).

    A problem is: arguments that are no JSON object, an unknown tool, a missing
    required parameter, a value of another type, or an unknown parameter.
    """
    key = ["message", "call_no"]
    schemas = schemas.select(F.coalesce(F.col("tool").cast("string"), F.lit("")).alias("tool"), "param", "type", F.coalesce("required", F.lit(False)).alias("required")).dropDuplicates(["tool", "param"])
    is_object = F.coalesce(F.schema_of_variant("args").startswith("OBJECT"), F.lit(False))
    objects = made.where(is_object)
    allowed = F.create_map(*[x for k, v in _TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    tools = schemas.select("tool").distinct().withColumn("known", F.lit(True))
    given = _given(made).join(tools, "tool").join(schemas, ["tool", "param"], "left")
    wrong = given.select(*key, F.when(F.col("type").isNull(), F.concat(F.lit("unknown parameter "), "param")).when(~F.coalesce(F.array_contains(allowed[F.col("type")], F.col("kind")), F.lit(True)), F.concat(F.lit("wrong type of "), "param")).alias("problem")).where("problem is not null")
    needed = objects.select(*key, "tool").join(schemas.where("required and param is not null"), "tool").select(*key, "param")
    missing = needed.join(given.select(*key, "param"), [*key, "param"], "left_anti").select(*key, F.concat(F.lit("missing "), "param").alias("problem"))
    plain = made.where(~is_object).select(*key, F.lit("arguments are not an object").alias("problem"))
    unknown = made.join(tools, "tool", "left_anti").select(*key, F.concat(F.lit("unknown tool "), "tool").alias("problem"))
    found = wrong.union(missing).union(plain).union(unknown).groupBy(*key).agg(F.sort_array(F.collect_set("problem")).alias("problems"))
    return made.join(found, key, "left").withColumn("problems", F.coalesce("problems", F.array().cast("array<string>")))


def topological(links: DataFrame, tables: Tables) -> DataFrame:
    """(message, _r, _d, _r0) of the messages (conv_id, message, up, turn, role, content) of a conversation in which a link may run backwards.

    up is the message that makes the call a message answers. Sorting by (_r, _d, _r0) puts every message behind its up: _r0 is its place
    by turn, role and content, _r the largest such place among itself and all messages above it, and _d how far above that one stands.
    Messages that answer each other in a ring keep their places, as if they answered nobody.
    Each round doubles how far a message looks up, so rounds are the logarithm of the longest chain.
    """
    some = links.dropDuplicates(["message"])
    nodes = tables.keep(ranks.places(some, ["conv_id"], ["turn", "role", "content", "message"], "_r0", keep=tables.keep).select("message", "up", "_r0"))
    steps = tables.keep(nodes.where("up is not null").select("message", "up"))
    longest = steps.count()
    ring, jumps = steps, 1
    while jumps <= longest and not ring.isEmpty():
        ring = tables.keep(ring.join(ring.select(F.col("message").alias("up"), F.col("up").alias("_up")), "up").select("message", F.col("_up").alias("up")))
        jumps *= 2
    # what still has somebody that far above it stands under a ring, and the one above is in it
    rings = ring.select(F.col("up").alias("message")).distinct().withColumn("_ring", F.lit(True))
    state = nodes.join(rings, "message", "left").select("message", F.when(F.col("_ring").isNull(), F.col("up")).alias("up"), F.col("_r0").alias("_r"), F.lit(0).cast("long").alias("_d"), "_r0")
    state, step = tables.keep(state), 1
    while not state.where("up is not null").isEmpty():
        above = state.select(F.col("message").alias("up"), F.col("up").alias("_up"), F.col("_r").alias("_ra"), F.col("_d").alias("_da"))
        higher = F.coalesce(F.col("_ra") > F.col("_r"), F.lit(False))
        state = tables.keep(state.join(above, "up", "left").select("message", F.col("_up").alias("up"), F.when(higher, F.col("_ra")).otherwise(F.col("_r")).alias("_r"), F.when(higher, F.col("_da") + step).otherwise(F.col("_d")).alias("_d"), "_r0"))
        step *= 2
    return state.select("message", "_r", "_d", "_r0")


def format_chats(conversations: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """One row for each message, in topological order: conv_id, turn, position, role, n_calls, link, problems, json.

    position counts from 0 within the conversation; messages keep the order of
    their turns (ties: role, then content), but a result never stands before the message that makes its call: it follows
    it, before whatever came later by turn (see `topological`, for rings too). A conversation of any length spreads over tasks.
    link is "call" (makes calls), "result" (its call exists), "orphan" (a result without a call),
    or "none". If a call id comes twice in a conversation, the earliest call counts.
    Nulls in role and text are empty; rows with a null conv_id make one conversation
    of their own; a null turn comes first; messages of one turn keep their own calls
    and problems. Repeated rows are kept. Without schemas only the form of the arguments
    is checked. Canonical JSON has sorted keys, no spaces, and arguments
    re-serialised from their parsed values; arguments that are no JSON or name a
    field twice are written as a JSON string of their text; a number beyond a double is written as "Infinity" and is a problem of the
    message. Other columns are not read, whatever
    their names; texts of any length are whole; an empty table gives an empty one.
    """
    tables = Tables(conversations.sparkSession, "chat")
    rows = messages(conversations)
    made = calls(rows)
    first = made.groupBy("conv_id", "call_id").agg(F.min(F.struct("call_turn", "call_no", "message")).alias("c")).select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.col("c.call_turn").alias("_turn"), F.col("c.message").alias("_up"))
    if schemas is None:
        bad = made.select("message", F.when(F.coalesce(F.schema_of_variant("args").startswith("OBJECT"), F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("arguments are not an object"))).alias("problems"))
    else:
        bad = check_arguments(made, schemas).select("message", "problems")
    bad = bad.groupBy("message").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("problems")))).alias("problems"))
    linked = rows.join(first, (F.col("conv_id").eqNullSafe(F.col("_conv"))) & (F.col("result_of") == F.col("_call")), "left").join(bad, "message", "left")
    found = F.col("_up").isNotNull()
    late = found & (F.coalesce("_turn", F.lit(-(1 << 63))) >= F.coalesce("turn", F.lit(-(1 << 63))))
    call = F.transform("calls", lambda c: F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json(F.try_parse_json(c["arguments"])), _quoted(c["arguments"])), F.lit(',"id":'), _quoted(c["id"]), F.lit(',"name":'), _quoted(c["name"]), F.lit("}")))
    field = lambda name, json: F.struct(F.lit(name).alias("key"), json.alias("json"))
    fields = F.filter(
        F.array(
            field("content", _quoted("content")),
            field("role", _quoted("role")),
            field("tool_call_id", F.when(F.col("result_of").isNotNull(), _quoted("result_of"))),
            field("tool_calls", F.when(F.size("calls") > 0, F.concat(F.lit("["), F.array_join(call, ","), F.lit("]")))),
        ),
        lambda e: e["json"].isNotNull(),
    )
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.concat(fields, "more")), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["json"])), ","), F.lit("}"))
    out = tables.keep(
        linked.select(
            "conv_id",
            "turn",
            "role",
            "content",
            "message",
            F.col("_up").alias("up"),
            late.alias("late"),
            F.size("calls").cast("long").alias("n_calls"),
            F.when(F.size("calls") > 0, "call").when(found, "result").when(F.col("result_of").isNotNull(), "orphan").otherwise("none").alias("link"),
            F.array_join(F.sort_array(F.concat(F.coalesce("problems", F.array().cast("array<string>")), F.when(F.col("beyond"), F.array(F.lit("a number is beyond a double"))).otherwise(F.array().cast("array<string>")))), "; ").alias("problems"),
            text.alias("json"),
        ),
        "messages",
    )
    moved = out.where("late").select(F.col("conv_id").alias("_conv")).distinct()
    order = ["turn", "role", "content", "message"]
    if not moved.isEmpty():
        # only where a result may stand before its call is there anything to sort by links
        own = out.join(moved, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi").select("conv_id", "message", "up", "turn", "role", "content")
        out = out.join(topological(own, tables), "message", "left")
        order = ["_r", "_d", "_r0", *order]
    placed = ranks.places(out, ["conv_id"], order, "position", keep=lambda df: tables.keep(df, "placed"))
    return placed.select("conv_id", "turn", "position", "role", "n_calls", "link", "problems", "json")


def _quoted(value) -> F.Column:
    """A JSON string literal."""
    column = F.col(value) if isinstance(value, str) else value
    return F.expr("''") + F.lit("") if column is None else F.regexp_extract(F.to_json(F.struct(column.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def op10_chat(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_chats(conversations, inferred_schemas(conversations))


ORACLE = """
SELECT conv_id, turn,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position,
       role, CAST(0 AS BIGINT) AS n_calls, 'none' AS link, '' AS problems,
       '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS json
FROM conversations
"""
