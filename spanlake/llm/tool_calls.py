"""Chat formatting with linked tool calls, with DataFrame and SQL functions only.

Messages are rows (conv_id, turn, role, content, tool_calls, tool_call_id): an assistant message may hold calls ``{id, name, arguments,
depends_on}`` with JSON arguments; a message of role ``tool`` answers the call it names. The operator

1. links calls and results by a hash join on (conversation, call id); a call id that is used again is answered in the order of turns, and a
   result that nobody asked for is an orphan;
2. orders topologically: messages by turn, the calls of one message after the calls they depend on (Kahn's rounds on the array of calls, in the row; calls
   on a cycle keep their order at the end and are marked), each result right after its call;
3. validates the arguments against the schema of the tool (required, type, no unknown names), on VARIANT values;
4. serialises each row as canonical JSON: sorted keys, no blanks, one spelling of each number.

The order is a key of four numbers, so no conversation is gathered in one task: sorting a partition range by it gives the transcript.

Defined cases: null content is an empty text; null or malformed arguments are invalid (``malformed``); a call of an unknown tool is invalid (``unknown_tool``);
messages with null conversation or turn are left out; repeated rows give repeated rows, and a call with several results in its slot gives a
row for each; an empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Kinds of JSON values that a schema may name, and how VARIANT spells their types.
_KINDS = {
    "string": "^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DOUBLE|DECIMAL\(.*\))$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<",
    "object": "^OBJECT<",
}
CALL = "struct<id: string, name: string, arguments: string, depends_on: array<string>>"

Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]


def canonical(text: Column) -> Column:
    """JSON text with sorted keys and no blanks; null if it is malformed."""
    return F.to_json(F.try_parse_json(text))


def quoted(text: Column) -> Column:
    """A text as a JSON string, whatever characters it holds."""
    held = F.to_json(F.struct(text.alias("v")))
    return F.substring(held, F.lit(6), F.length(held) - 6)


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Array of errors of one call: ``unknown_tool``, ``malformed``, ``missing:x``, ``type:x``, ``unknown:x``."""
    value = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    checks = F.array(F.lit("unknown_tool"))
    for tool, fields in schemas.items():
        found = []
        for field, (kind, required) in fields.items():
            if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", field):
                held = F.try_variant_get(value, f"$.{field}", "variant")
            else:  # a name that would say something else in a path
                held = F.try_variant_get(value, "$", "map<string, variant>")[field]
            there = F.array_contains(keys, field)
            wrong = there & ~F.coalesce(F.schema_of_variant(held), F.lit("VOID")).rlike(_KINDS[kind])
            found.append(F.when(wrong, F.lit(f"type:{field}")))
            if required:
                found.append(F.when(~there, F.lit(f"missing:{field}")))
        strange = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(f) for f in fields]))), lambda k: F.concat(F.lit("unknown:"), k))
        errors = F.concat(F.filter(F.array(*found), lambda e: e.isNotNull()), strange)
        malformed = value.isNull() | keys.isNull()
        checks = F.when(name == tool, F.when(malformed, F.array(F.lit("malformed"))).otherwise(errors)).otherwise(checks)
    return checks


def order_calls(calls: Column) -> Column:
    """The calls of one message as ``{call, cyclic}``, each after those it depends on.

    Each round takes all calls whose dependencies inside the message are taken. The number of rounds is at most the number of calls.
    """
    ids = F.transform(calls, lambda c: c["id"])
    wants = lambda c: F.array_intersect(F.coalesce(c["depends_on"], F.array().cast("array<string>")), ids)

    def step(state: Column, _: Column) -> Column:
        taken = F.transform(state["done"], lambda c: c["id"])
        ready = F.filter(state["left"], lambda c: F.size(F.array_except(wants(c), taken)) == 0)
        waiting = F.filter(state["left"], lambda c: F.size(F.array_except(wants(c), taken)) > 0)
        return F.struct(F.concat(state["done"], ready).alias("done"), waiting.alias("left"))

    start = F.struct(F.slice(calls, 1, 0).alias("done"), calls.alias("left"))
    ended = F.aggregate(F.sequence(F.lit(1), F.size(calls)), start, step)
    mark = lambda cyclic: lambda c: F.struct(c.alias("call"), F.lit(cyclic).alias("cyclic"))
    both = F.concat(F.transform(ended["done"], mark(False)), F.transform(ended["left"], mark(True)))
    return F.when(F.size(calls) > 0, both)


def link_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per message, call and result, with its place, link, errors and canonical JSON.

    Place: ``turn`` of the message that the row belongs to, ``call`` (-1: the message itself), ``step`` (0 call, 1 result) and ``result_turn``.
    """
    told = messages.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        "role",
        F.coalesce("content", F.lit("")).alias("content"),
        F.col("tool_calls").cast(f"array<{CALL}>").alias("calls"),
        F.col("tool_call_id").cast("string").alias("call_id"),
    ).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    is_result = F.coalesce((F.col("role") == "tool") & F.col("call_id").isNotNull(), F.lit(False))

    calls = told.where(~is_result & (F.size("calls") > 0)).select("conv_id", "turn", F.posexplode(order_calls(F.col("calls"))).alias("call", "entry"))
    calls = calls.select(
        "conv_id",
        "turn",
        "call",
        F.col("entry.call.id").alias("call_id"),
        F.col("entry.call.name").alias("name"),
        F.col("entry.call.arguments").alias("arguments"),
        F.col("entry.cyclic").alias("cyclic"),
    )
    calls = calls.withColumn("errors", argument_errors(F.col("name"), F.col("arguments"), schemas))
    results = told.where(is_result).select("conv_id", "call_id", F.col("turn").alias("result_turn"), F.col("content").alias("result"))

    # The n-th use of an id is answered by the n-th result that carries it; ids are unique in sane logs, so these groups are small.
    nth = lambda place: F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy(*place))
    asked = calls.select("conv_id", "call_id", F.col("turn").alias("ask_turn"), F.col("call").alias("ask_call"), nth(["turn", "call"]).alias("use"))
    answered = results.withColumn("use", nth(["result_turn", "result"]))
    linked = answered.join(asked.hint("shuffle_hash"), ["conv_id", "call_id", "use"], "left")
    given = linked.where("ask_turn IS NOT NULL").select("conv_id", "ask_turn", "ask_call", F.lit(True).alias("answered")).distinct()
    calls = calls.join(
        given.hint("shuffle_hash"), (calls["conv_id"] == given["conv_id"]) & (calls["turn"] == given["ask_turn"]) & (calls["call"] == given["ask_call"]), "left"
    ).select(calls["*"], F.coalesce("answered", F.lit(False)).alias("linked"))

    none = lambda kind: F.lit(None).cast(kind)
    empty = F.array().cast("array<string>")
    text = F.to_json(F.named_struct(F.lit("content"), F.col("content"), F.lit("role"), F.coalesce("role", F.lit(""))))
    plain = told.where(~is_result).select(
        "conv_id", "turn", F.lit(-1).alias("call"), F.lit(0).alias("step"), none("bigint").alias("result_turn"), F.lit("message").alias("kind"),
        none("string").alias("call_id"), none("boolean").alias("linked"), empty.alias("errors"), F.lit(False).alias("cyclic"), text.alias("json"),
    )
    spelled = F.coalesce(canonical(F.col("arguments")), quoted(F.coalesce("arguments", F.lit(""))))
    call_json = F.concat(
        F.lit('{"arguments":'), spelled, F.lit(',"id":'), quoted(F.coalesce("call_id", F.lit(""))), F.lit(',"name":'), quoted(F.coalesce("name", F.lit(""))), F.lit("}")
    )
    asked_rows = calls.select(
        "conv_id", "turn", "call", F.lit(0).alias("step"), none("bigint").alias("result_turn"), F.lit("call").alias("kind"), "call_id", "linked", "errors", "cyclic", call_json.alias("json")
    )
    result_json = F.to_json(F.named_struct(F.lit("content"), F.col("result"), F.lit("role"), F.lit("tool"), F.lit("tool_call_id"), F.col("call_id")))
    result_rows = linked.select(
        "conv_id",
        F.coalesce("ask_turn", "result_turn").alias("turn"),
        F.coalesce("ask_call", F.lit(-1)).alias("call"),
        F.lit(1).alias("step"),
        "result_turn",
        F.when(F.col("ask_turn").isNull(), "orphan").otherwise("result").alias("kind"),
        "call_id",
        F.col("ask_turn").isNotNull().alias("linked"),
        empty.alias("errors"),
        F.lit(False).alias("cyclic"),
        result_json.alias("json"),
    )
    return plain.unionByName(asked_rows).unionByName(result_rows)


def write_transcripts(linked: DataFrame, path: str) -> None:
    """Files of canonical lines: each holds a range of conversations in order; a long conversation may span several files."""
    order = ["conv_id", "turn", "call", "step", "result_turn"]
    linked.repartitionByRange(*order).sortWithinPartitions(*order).select("json").write.mode("overwrite").text(path)
