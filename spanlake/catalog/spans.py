"""Registered queries on spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (
    attr,
    attrs_map,
    flatten_content,
    last_content,
    normalize_ts,
    shard_label,
    to_epoch,
    truncate_text,
    with_default_ids,
)
from ..operators import spans as ops, store, turns
from . import fixtures as fx
from .registry import registry

QUERIES, ORACLE, query = registry()

TOKENS = (
    "sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,"
    " sum(total_tokens)::BIGINT AS total_tokens"
)


@query("token_totals", f"WITH {fx.SPANS} SELECT {TOKENS} FROM spans")
def token_totals(spark, folder):
    return ops.token_totals(fx.spans(spark, folder))


@query("token_totals_by_model", f"WITH {fx.SPANS} SELECT model, {TOKENS} FROM spans GROUP BY model")
def token_totals_by_model(spark, folder):
    return ops.token_totals(fx.spans(spark, folder), ["model"])


@query("token_totals_by_rollout", f"WITH {fx.SPANS} SELECT rollout_id, {TOKENS} FROM spans GROUP BY rollout_id")
def token_totals_by_rollout(spark, folder):
    return ops.token_totals(fx.spans(spark, folder), ["rollout_id"])


@query(
    "token_totals_by_shard",
    f"WITH {fx.SPANS} SELECT {fx.shard_sql('start_time', 30)} AS shard, {TOKENS} FROM spans GROUP BY 1",
)
def token_totals_by_shard(spark, folder):
    spans = fx.spans(spark, folder).withColumn("shard", shard_label(F.col("start_time"), 30))
    return ops.token_totals(spans, ["shard"])


_FLAT = "rollout_id, attempt_id, sequence_id, span_id, trace_id, start_time, end_time"
_FLAT_COLUMNS = _FLAT.split(", ")


@query(
    "query_spans_by_rollout",
    f"WITH {fx.SPANS} SELECT {_FLAT} FROM spans WHERE rollout_id = 'ro-000000000007'"
    " ORDER BY start_time, sequence_id, span_id LIMIT 100",
)
def query_spans_by_rollout(spark, folder):
    return ops.query_spans(fx.spans(spark, folder), rollout_id="ro-000000000007").select(*_FLAT_COLUMNS)


@query(
    "query_spans_by_attempt",
    f"WITH {fx.SPANS} SELECT {_FLAT} FROM spans WHERE rollout_id = 'ro-000000000005' AND attempt_id = 'at-00000005'"
    " ORDER BY start_time, sequence_id, span_id LIMIT 2",
)
def query_spans_by_attempt(spark, folder):
    found = ops.query_spans(fx.spans(spark, folder), "ro-000000000005", "at-00000005", limit=2)
    return found.select(*_FLAT_COLUMNS)


@query(
    "query_spans_default_limit",
    f"WITH {fx.SPANS} SELECT {_FLAT} FROM spans ORDER BY start_time, sequence_id, span_id LIMIT 100",
)
def query_spans_default_limit(spark, folder):
    return ops.query_spans(fx.spans(spark, folder)).select(*_FLAT_COLUMNS)


@query("latest_calls", f"WITH {fx.SPANS} SELECT {_FLAT} FROM spans ORDER BY start_time DESC, span_id LIMIT 20")
def latest_calls(spark, folder):
    return ops.latest(fx.spans(spark, folder), 20).select(*_FLAT_COLUMNS)


@query("earliest_calls", f"WITH {fx.SPANS} SELECT {_FLAT} FROM spans ORDER BY start_time, span_id LIMIT 20")
def earliest_calls(spark, folder):
    return ops.earliest(fx.spans(spark, folder), 20).select(*_FLAT_COLUMNS)


@query(
    "llm_calls",
    f"""WITH {fx.SPANS} SELECT 'llm.completion' AS name, count(*) AS calls, min(start_time) AS first_start,
    max(end_time) AS last_end FROM spans""",
)
def llm_calls(spark, folder):
    both = ops.union_spans(fx.spans(spark, folder), fx.event_spans(spark, folder))
    return ops.llm_calls(both).groupBy("name").agg(
        F.count("*").alias("calls"), F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end")
    )


@query(
    "union_spans",
    f"""WITH {fx.SPANS}, {fx.EVENT_SPANS}, both_kinds AS (
    SELECT 'llm.completion' AS name, rollout_id, start_time FROM spans
    UNION ALL SELECT name, rollout_id, start_time FROM event_spans)
    SELECT name, count(*) AS spans, count(DISTINCT rollout_id) AS rollouts, min(start_time) AS first_start
    FROM both_kinds GROUP BY name""",
)
def union_spans(spark, folder):
    events = fx.event_spans(spark, folder).drop("kind", "resource_attributes")
    return ops.union_spans(fx.spans(spark, folder), events).groupBy("name").agg(
        F.count("*").alias("spans"),
        F.count_distinct("rollout_id").alias("rollouts"),
        F.min("start_time").alias("first_start"),
    )


@query(
    "span_duration",
    f"""WITH {fx.SPANS} SELECT model, round(sum(end_time - start_time), 3) AS total, round(max(end_time - start_time), 6)
    AS longest FROM spans GROUP BY model""",
)
def span_duration(spark, folder):
    model = attr(F.col("attributes"), "llm.model").alias("model")
    timed = ops.with_duration(fx.spans(spark, folder))
    return timed.groupBy(model).agg(
        F.round(F.sum("duration"), 3).alias("total"), F.round(F.max("duration"), 6).alias("longest")
    )


@query(
    "shard_counts",
    f"""WITH {fx.EVENT_SPANS} SELECT w AS width, shard, count(*) AS spans FROM (
    SELECT 7 AS w, {fx.shard_sql('start_time', 7)} AS shard FROM event_spans
    UNION ALL SELECT 5, {fx.shard_sql('start_time', 5)} FROM event_spans) GROUP BY ALL""",
)
def shard_counts(spark, folder):
    at = F.col("start_time")
    labels = F.explode(
        F.array(*[F.struct(F.lit(m).alias("width"), shard_label(at, m).alias("shard")) for m in (7, 5)])
    )
    labelled = fx.event_spans(spark, folder).select(labels.alias("s")).select("s.*")
    return labelled.groupBy("width", "shard").agg(F.count("*").alias("spans"))


@query(
    "normalize_ts",
    """SELECT event_id, round(epoch_us(ts) / 1e6, 3) AS from_ns,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE floor(epoch_us(ts) / 1e6) END AS from_s FROM events""",
)
def normalize(spark, folder):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.floor(micros / 1e6))
    return fx.table(spark, folder, "events").select(
        "event_id",
        F.round(normalize_ts(micros * 1000), 3).alias("from_ns"),
        normalize_ts(seconds).alias("from_s"),
    )


@query(
    "to_epoch",
    """SELECT event_type, round(min(epoch_us(ts)) / 1e6, 6) AS first, round(max(epoch_us(ts)) / 1e6, 6) AS last,
    sum(value) > 0 AS positive FROM events GROUP BY event_type""",
)
def epochs(spark, folder):
    at = to_epoch(F.col("ts"))
    return fx.table(spark, folder, "events").groupBy("event_type").agg(
        F.round(F.min(at), 6).alias("first"),
        F.round(F.max(at), 6).alias("last"),
        (F.sum(to_epoch(F.col("value"), is_timestamp=False)) > 0).alias("positive"),
    )


@query(
    "flatten_span",
    f"""WITH {fx.SPANS} SELECT {_FLAT}, 'INTERNAL' AS kind, 'UNSET' AS status,
    '{{"llm.model":"' || model || '","llm.usage.total_tokens":' || total_tokens::VARCHAR || '}}' AS attributes,
    '{{}}' AS resource_attributes FROM spans""",
)
def flatten_span(spark, folder):
    bare = fx.spans(spark, folder).withColumns(
        {
            "kind": F.lit(None).cast("string"),
            "status": F.lit(None).cast("string"),
            "resource_attributes": F.lit(None).cast("string"),
        }
    )
    nested = ops.nest_span(bare)
    kept = F.map_filter("attributes", lambda k, _: k.isin("llm.model", "llm.usage.total_tokens"))
    flat = ops.flatten_span(nested.withColumn("attributes", kept))
    return flat.select(*_FLAT_COLUMNS, "kind", "status", "attributes", "resource_attributes")


@query(
    "nest_span",
    f"""WITH {fx.SPANS} SELECT span_id, trace_id, model, total_tokens, 'spanlake' AS service,
    (CASE WHEN system IS NULL THEN 6 ELSE 7 END)::BIGINT AS attributes FROM spans""",
)
def nest_span(spark, folder):
    nested = ops.nest_span(fx.spans(spark, folder))
    return nested.select(
        "context.span_id",
        "context.trace_id",
        F.variant_get(F.col("attributes")["llm.model"], "$", "string").alias("model"),
        F.variant_get(F.col("attributes")["llm.usage.total_tokens"], "$", "bigint").alias("total_tokens"),
        F.variant_get(F.col("resource.attributes")["service.name"], "$", "string").alias("service"),
        F.size("attributes").cast("bigint").alias("attributes"),
    )


@query(
    "attr_extract",
    """SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total,
    max(json_extract_string(props, '$.k')) AS largest_text, 0::BIGINT AS missing FROM events GROUP BY event_type""",
)
def attr_extract(spark, folder):
    props = F.col("props")
    return fx.table(spark, folder, "events").groupBy("event_type").agg(
        F.sum(attr(props, "k", "bigint")).alias("total"),
        F.max(attr(props, "k")).alias("largest_text"),
        F.count(attr(props, "llm.model")).alias("missing"),
    )


@query(
    "attrs_map",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, 1::BIGINT AS keys, 0::BIGINT AS bad_keys FROM events""",
)
def all_attributes(spark, folder):
    parsed = attrs_map(F.col("props"))
    broken = attrs_map(F.substring("props", 2, F.length("props")))
    return fx.table(spark, folder, "events").select(
        "event_id",
        parsed["k"].alias("k"),
        F.size(parsed).cast("bigint").alias("keys"),
        F.size(broken).cast("bigint").alias("bad_keys"),
    )


@query(
    "default_ids",
    """SELECT event_id, 'ro-' || substr(sha256('rollout_id|' || event_id::VARCHAR), 1, 12) AS rollout_id,
    CASE WHEN event_id % 2 = 0 THEN 'at-given' ELSE 'at-' || substr(sha256('attempt_id|' || event_id::VARCHAR), 1, 8) END
    AS attempt_id FROM events""",
)
def default_ids(spark, folder):
    events = fx.table(spark, folder, "events").withColumn(
        "attempt_id", F.when(F.col("event_id") % 2 == 0, "at-given")
    )
    return with_default_ids(events, ["event_id"]).select("event_id", "rollout_id", "attempt_id")


@query(
    "truncate_text",
    """SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS short,
    CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '... (truncated)' ELSE text END AS longer FROM conversations""",
)
def truncated(spark, folder):
    text = F.col("text")
    return fx.table(spark, folder, "conversations").select(
        "conv_id", "turn", truncate_text(text, 200, "...").alias("short"), truncate_text(text, 300).alias("longer")
    )


@query(
    "validate_spans",
    f"""WITH {fx.SPANS}, marked AS (SELECT *, CASE conv_id % 5 WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false
    ELSE true END AS valid FROM spans)
    SELECT valid, count(*) AS spans, count(DISTINCT rollout_id) AS rollouts FROM marked GROUP BY valid""",
)
def validate_spans(spark, folder):
    number = F.substring("attempt_id", 4, 8).cast("bigint") % 5
    spoiled = fx.spans(spark, folder).withColumns(
        {
            "kind": F.when(number == 1, "ROBOT").otherwise(F.col("kind")),
            "status": F.when(number == 2, "DONE").otherwise(F.col("status")),
            "attributes": F.when(number == 3, "no json").otherwise(F.col("attributes")),
        }
    )
    good, bad = ops.validate_spans(spoiled)
    marked = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return marked.groupBy("valid").agg(F.count("*").alias("spans"), F.count_distinct("rollout_id").alias("rollouts"))


@query(
    "flatten_content",
    """SELECT conv_id, turn, role, CASE WHEN role = 'user'
    THEN text || chr(10) || '[Image: ' || substr('https://images.example/' || text, 1, 60) || '...]'
    WHEN length(text) > 500 THEN substr(text, 1, 500) || '... (truncated)' ELSE text END AS content FROM conversations""",
)
def flattened(spark, folder):
    url = F.struct(F.concat(F.lit("https://images.example/"), "text").alias("url"))
    parts = F.array(
        F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("STRUCT<url: STRING>").alias("image_url")),
        F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), url.alias("image_url")),
        F.struct(F.lit("audio").alias("type"), F.lit("skipped").alias("text"), F.lit(None).cast("STRUCT<url: STRING>").alias("image_url")),
    )
    with_parts = F.to_json(F.array(F.struct("role", parts.alias("content"))))
    plain = F.to_json(F.array(F.struct("role", F.col("text").alias("content"))))
    messages = F.when(F.col("role") == "user", with_parts).otherwise(plain)
    flat = fx.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.explode(flatten_content(messages, width=500)).alias("m")
    )
    return flat.select("conv_id", "turn", "m.role", "m.content")


@query(
    "last_user_message",
    f"WITH {fx.SPANS} SELECT span_id, last_user FROM spans",
)
def last_user_message(spark, folder):
    messages = attr(F.col("attributes"), "llm.request.messages")
    return fx.spans(spark, folder).select("span_id", last_content(messages).alias("last_user"))


def _cut(column: str, width: int) -> str:
    return f"CASE WHEN length({column}) > {width} THEN substr({column}, 1, {width}) || '... (truncated)' ELSE {column} END"


@query(
    "call_view",
    f"""WITH {fx.SPANS} SELECT span_id, strftime(make_timestamp((start_time * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS time,
    model, round((end_time - start_time) * 1000)::BIGINT AS duration_ms, 'OK' AS status,
    {_cut('system', 300)} AS system,
    coalesce(array_to_string(list_transform(messages, lambda m: '[' || m.role || ']: ' || {_cut('m.content', 500)}), chr(10)), '')
    AS input, NULL::VARCHAR AS reasoning, {_cut('response', 1000)} AS response,
    prompt_tokens, completion_tokens, total_tokens FROM spans""",
)
def call_view(spark, folder):
    return ops.call_view(fx.spans(spark, folder))


@query(
    "with_sequence",
    """WITH numbered AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id
    ORDER BY epoch_us(ts) / 1e6, 'e' || event_id::VARCHAR) - 1 AS n FROM events)
    SELECT 'e' || event_id::VARCHAR AS span_id, n::BIGINT AS sequence_id FROM numbered""",
)
def with_sequence(spark, folder):
    return ops.with_sequence(fx.event_spans(spark, folder)).select("span_id", "sequence_id")


@query(
    "trajectory_ends",
    f"""WITH {fx.SPANS} SELECT rollout_id, attempt_id, arg_min(span_id, sequence_id) AS first_span,
    arg_max(span_id, sequence_id) AS last_span, arg_max(response, sequence_id) AS last_response, count(*) AS spans
    FROM spans GROUP BY rollout_id, attempt_id""",
)
def trajectory_ends(spark, folder):
    return ops.trajectory_ends(fx.spans(spark, folder)).select(
        "rollout_id",
        "attempt_id",
        F.col("first.span_id").alias("first_span"),
        F.col("last.span_id").alias("last_span"),
        attr(F.col("last.attributes"), "llm.response.content").alias("last_response"),
        "spans",
    )


@query(
    "with_history",
    """SELECT c.conv_id, c.turn, c.role, coalesce((SELECT to_json(list({'turn': h.turn, 'role': h.role, 'text': h.text}
    ORDER BY h.turn)) FROM conversations h WHERE h.conv_id = c.conv_id AND h.turn < c.turn)::VARCHAR, '[]') AS history
    FROM conversations c""",
)
def with_history(spark, folder):
    told = turns.with_history(fx.table(spark, folder, "conversations"))
    return told.select("conv_id", "turn", "role", F.to_json("history").alias("history"))


# Twenty conversations put behind each other, with gaps in their turn numbers.
_CHAINED = """chained AS (SELECT conv_id // 20 AS conv_id, (conv_id % 20) * 1000 + turn AS turn, role, text FROM conversations)"""


def chained(spark, folder):
    """Long conversations: twenty of the given ones put behind each other."""
    told = fx.table(spark, folder, "conversations")
    order = F.col("conv_id") % 20 * 1000 + F.col("turn")
    return told.select(F.floor(F.col("conv_id") / 20).cast("bigint").alias("conv_id"), order.alias("turn"), "role", "text")


@query(
    "with_history_long",
    f"""WITH {_CHAINED} SELECT c.conv_id, c.turn, c.role, coalesce((SELECT to_json(list({{'turn': h.turn, 'role': h.role, 'text': h.text}}
    ORDER BY h.turn)) FROM chained h WHERE h.conv_id = c.conv_id AND h.turn < c.turn)::VARCHAR, '[]') AS history FROM chained c""",
)
def with_history_long(spark, folder):
    """Conversations of many parts, each of 7 turns: histories are complete."""
    told = turns.with_history(chained(spark, folder), part_turns=7)
    return told.select("conv_id", "turn", "role", F.to_json("history").alias("history"))


@query(
    "preview",
    f"""WITH {fx.SPANS} SELECT rollout_id, substr(response, 1, 100) AS response, sequence_id::VARCHAR AS sequence_id
    FROM spans ORDER BY start_time, span_id LIMIT 10""",
)
def preview(spark, folder):
    calls = fx.calls(spark, folder).withColumn("span_id", fx.span_id())
    return store.preview(calls.orderBy("start_time", "span_id").select("rollout_id", "response", "sequence_id"), 10)


@query(
    "table_shape",
    "SELECT count(*) AS rows, 6::BIGINT AS columns, 'event_id, ts, user_id, event_type, value, props' AS names FROM events",
)
def table_shape(spark, folder):
    return store.shape(fx.table(spark, folder, "events")).withColumn("columns", F.col("columns").cast("bigint"))
