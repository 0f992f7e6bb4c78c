"""The given tables in the shapes the operators work on, and the same as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import to_epoch
from ..operators.capture import build_spans
from ..operators.turns import calls_from_turns
from ..session import scratch_path
from ..sinks import write_spans
from ..sources import read_spans


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """One call per assistant turn of ``conversations``."""
    return calls_from_turns(table(spark, folder, "conversations"))


def span_id() -> Column:
    return F.substring(F.md5(F.concat("rollout_id", F.lit("-"), F.col("sequence_id").cast("string"))), 1, 16)


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """The calls as flat spans."""
    attributes = F.struct(
        F.col("model").alias("llm.model"),
        F.to_json("messages").alias("llm.request.messages"),
        F.col("system").alias("llm.request.system"),
        F.col("response").alias("llm.response.content"),
        F.col("prompt_tokens").alias("llm.usage.prompt_tokens"),
        F.col("completion_tokens").alias("llm.usage.completion_tokens"),
        F.col("total_tokens").alias("llm.usage.total_tokens"),
    )
    return calls(spark, folder).select(
        F.lit("llm.completion").alias("name"),
        F.md5("rollout_id").alias("trace_id"),
        span_id().alias("span_id"),
        F.lit(None).cast("string").alias("parent_id"),
        "start_time",
        "end_time",
        F.lit("CLIENT").alias("kind"),
        F.lit("OK").alias("status"),
        F.to_json(attributes).alias("attributes"),
        "rollout_id",
        "attempt_id",
        "sequence_id",
        F.lit('{"service.name":"spanlake","llm.provider":"litellm"}').alias("resource_attributes"),
    )


def as_event_spans(events: DataFrame) -> DataFrame:
    """``events`` as spans that are not calls: one trace per user, one parent per chain of four."""
    at = to_epoch(F.col("ts"))
    chained = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("e"), (F.col("event_id") - 1).cast("string")))
    return events.select(
        F.concat(F.lit("event."), "event_type").alias("name"),
        F.md5(F.col("user_id").cast("string")).alias("trace_id"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("span_id"),
        chained.alias("parent_id"),
        at.alias("start_time"),
        (at + F.col("value") / 1000).alias("end_time"),
        F.lit("INTERNAL").alias("kind"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("status"),
        F.col("props").alias("attributes"),
        F.concat(F.lit("ro-u"), F.col("user_id").cast("string")).alias("rollout_id"),
        F.concat(F.lit("at-u"), F.col("user_id").cast("string")).alias("attempt_id"),
        F.lit(0).cast("bigint").alias("sequence_id"),
        F.lit("{}").alias("resource_attributes"),
    )


def event_spans(spark: SparkSession, folder: str) -> DataFrame:
    return as_event_spans(table(spark, folder, "events"))


def log_columns() -> list[Column]:
    """Access-log columns of an event."""
    kind, user, value = F.col("event_type"), F.col("user_id"), F.col("value")
    is_error, is_response = kind == "error", kind.isin("purchase", "signup")
    number = F.col("event_id").cast("string")
    entry = F.when(is_error, "error").when(is_response, "response").otherwise("request")
    path = F.concat(F.lit("/v1/"), kind, F.lit("/"), (user % 7).cast("string"))
    failed = F.when(is_error, "upstream").when((kind == "signup") & (user % 10 == 0), "timeout")
    return [
        entry.alias("type"),
        F.when(is_response, F.concat(F.lit("r"), (F.col("event_id") - 1).cast("string")))
        .when(~is_error, F.concat(F.lit("r"), number))
        .alias("request_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(~is_response, "POST").alias("method"),
        F.when(~is_response, path).alias("path"),
        F.create_map(F.lit("x-user"), user.cast("string")).alias("headers"),
        F.when(~is_error, F.col("props")).alias("body"),
        F.when(is_response, F.when(user % 10 == 0, 500).when(user % 10 == 1, 401).otherwise(200)).alias("status_code"),
        failed.alias("error"),
        F.lit(None).cast("string").alias("request_method"),
        F.lit(None).cast("string").alias("request_path"),
        F.when(is_response & (value >= 1), value).alias("duration_ms"),
    ]


def access_log(events: DataFrame) -> DataFrame:
    """``events`` as access-log entries; also for a stream of them."""
    return events.select(*log_columns())


def log(spark: SparkSession, folder: str) -> DataFrame:
    return access_log(table(spark, folder, "events"))


def rewards(spark: SparkSession, folder: str) -> DataFrame:
    """A reward per rollout from ``labels``."""
    rollout = F.concat(F.lit("ro-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return table(spark, folder, "labels").select(rollout.alias("rollout_id"), F.col("quality").cast("double").alias("reward"))


# Reasoning text, tool calls and tool results the conversations do not have are derived from turn and
# model, so that each response shape carries every part.


def raw_calls(spark: SparkSession, folder: str) -> DataFrame:
    """The calls as raw JSON: arguments in three layouts, responses in three shapes, by conversation."""
    base = calls(spark, folder).withColumn("tool_id", F.concat_ws("-", F.lit("c"), "conv_id", "turn"))
    kind = F.col("conv_id") % 3
    empty = F.array().cast("ARRAY<STRUCT<role: STRING, content: STRING, tool_call_id: STRING>>")

    def message(role: Column, content: Column, tool_call_id: Column) -> Column:
        return F.struct(role.alias("role"), content.alias("content"), tool_call_id.alias("tool_call_id"))

    none = F.lit(None).cast("string")
    plain = F.transform("messages", lambda m: message(m["role"], m["content"], none))
    lead = F.when(F.col("system").isNotNull(), F.array(message(F.lit("system"), F.col("system"), none))).otherwise(empty)
    tool = F.when(
        F.col("sequence_id") % 2 == 1,
        F.array(message(F.lit("tool"), F.concat(F.lit("result of "), "tool_id"), F.col("tool_id"))),
    ).otherwise(empty)
    payload = base.withColumn("messages", F.concat(lead, plain, tool)).withColumns(
        {
            "temperature": F.when(F.col("turn") % 2 == 1, 0.5),
            "max_tokens": F.when(F.col("conv_id") % 2 == 0, F.lit(256)),
            "tools": F.when(
                F.col("conv_id") % 5 == 0, F.array(F.struct(F.lit("function").alias("type"), F.lit("lookup").alias("name")))
            ),
        }
    )
    body = ("messages", "temperature", "max_tokens", "tools")
    top = F.to_json(F.struct("model", *body))
    inner = F.to_json(F.struct("model", F.struct(*body).alias("litellm_params")))
    data = F.to_json(F.struct(F.struct("model", *body).alias("data")))

    reasoning = F.concat(F.lit("because "), "tool_id")
    arguments = F.to_json(F.struct(F.col("turn").alias("q")))
    usage = F.struct("prompt_tokens", "completion_tokens", "total_tokens").alias("usage")
    chat = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.struct(
                        F.col("response").alias("content"),
                        F.when(F.col("turn") % 4 == 1, reasoning).alias("reasoning_content"),
                        F.array(
                            F.struct(
                                F.col("tool_id").alias("id"),
                                F.lit("function").alias("type"),
                                F.struct(F.lit("lookup").alias("name"), arguments.alias("arguments")).alias("function"),
                            )
                        ).alias("tool_calls"),
                    ).alias("message"),
                    F.struct(
                        F.when(F.col("turn") % 4 != 1, reasoning).alias("reasoning"),
                        F.array("turn", "conv_id").alias("token_ids"),
                    ).alias("provider_specific_fields"),
                )
            ).alias("choices"),
            usage,
            F.array(F.lit(1), F.lit(2)).alias("prompt_token_ids"),
        )
    )
    half = F.floor(F.length("response") / 2).cast("int")
    start, rest = F.substring("response", F.lit(1), half), F.substring("response", half + 1, F.length("response"))

    def block(kind_: str, **fields: Column) -> Column:
        typed = {"text": none, "id": none, "name": none, "input": F.lit(None).cast("STRUCT<q: BIGINT>")}
        return F.struct(F.lit(kind_).alias("type"), *[fields.get(n, v).alias(n) for n, v in typed.items()])

    use = block("tool_use", id=F.col("tool_id"), name=F.lit("lookup"), input=F.struct(F.col("turn").alias("q")))
    blocks = F.to_json(F.struct(F.array(block("text", text=start), use, block("text", text=rest)).alias("content"), usage))
    output = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.lit("Reasoning").alias("type"), F.array(block("reasoning_text", text=reasoning)).alias("content")
                ),
                F.struct(
                    F.lit("message").alias("type"),
                    F.array(block("output_text", text=start), use, block("output_text", text=rest)).alias("content"),
                ),
            ).alias("output"),
            usage,
        )
    )
    failed = F.col("turn") == 7
    return payload.select(
        "tool_id",
        F.concat_ws("-", F.lit("call"), "conv_id", "turn").alias("call_id"),
        F.when(kind == 0, top).when(kind == 1, inner).otherwise(data).alias("kwargs"),
        F.when(~failed, F.when(kind == 0, chat).when(kind == 1, blocks).otherwise(output)).alias("response"),
        F.when(failed & (F.col("conv_id") % 2 == 0), F.lit("upstream")).alias("error"),
        "start_time",
        "end_time",
        "rollout_id",
        "attempt_id",
        "sequence_id",
    )


_LAKES: dict[tuple, str] = {}


def captured_path(spark: SparkSession, folder: str) -> str:
    """A lake of the captured spans, written once per application and state of the input files."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/conversations.parquet")
    state = listing.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()[0]
    key = (spark.sparkContext.applicationId, folder, state)
    if key not in _LAKES:
        path = scratch_path(spark, "captured")
        write_spans(build_spans(raw_calls(spark, folder)), path, window_minutes=60)
        _LAKES[key] = path
    return _LAKES[key]


def captured(spark: SparkSession, folder: str) -> DataFrame:
    return read_spans(spark, captured_path(spark, folder), promoted=True).drop("shard")


# --- the same in SQL --------------------------------------------------------------------------

CALLS = """
calls AS (
  SELECT c.conv_id, c.turn,
    'ro-' || lpad(c.conv_id::VARCHAR, 12, '0') AS rollout_id,
    'at-' || lpad(c.conv_id::VARCHAR, 8, '0') AS attempt_id,
    (SELECT count(*) FROM conversations h
      WHERE h.conv_id = c.conv_id AND h.turn < c.turn AND h.role = 'assistant')::BIGINT AS sequence_id,
    'model_' || (c.conv_id % 3)::VARCHAR AS model,
    (SELECT CASE WHEN arg_min(h.role, h.turn) = 'system' THEN arg_min(h.text, h.turn) END
      FROM conversations h WHERE h.conv_id = c.conv_id) AS system,
    coalesce((SELECT list({'role': h.role, 'content': h.text} ORDER BY h.turn) FROM conversations h
      WHERE h.conv_id = c.conv_id AND h.turn < c.turn AND h.role <> 'system'), []) AS messages,
    (SELECT arg_max(h.text, h.turn) FROM conversations h
      WHERE h.conv_id = c.conv_id AND h.turn < c.turn AND h.role = 'user') AS last_user,
    c.text AS response,
    1704067200.0::DOUBLE + c.conv_id * 600 + c.turn * 5 AS start_time,
    1704067200.0::DOUBLE + c.conv_id * 600 + c.turn * 5 + (length(c.text) % 4000) / 1000.0::DOUBLE AS end_time,
    coalesce((SELECT sum(length(h.text)) FROM conversations h
      WHERE h.conv_id = c.conv_id AND h.turn < c.turn AND h.role <> 'system'), 0)::BIGINT AS prompt_tokens,
    length(c.text)::BIGINT AS completion_tokens
  FROM conversations c WHERE c.role = 'assistant'
)"""

SPANS = (
    CALLS
    + """,
spans AS (
  SELECT *, prompt_tokens + completion_tokens AS total_tokens,
    md5(rollout_id) AS trace_id,
    substr(md5(rollout_id || '-' || sequence_id::VARCHAR), 1, 16) AS span_id
  FROM calls
)"""
)

# A span's attributes as the writer lays them out: absent keys are left out.
ATTRIBUTES = """'{"llm.model":' || to_json(model)::VARCHAR
    || ',"llm.request.messages":' || to_json(to_json(messages)::VARCHAR)::VARCHAR
    || CASE WHEN system IS NULL THEN '' ELSE ',"llm.request.system":' || to_json(system)::VARCHAR END
    || ',"llm.response.content":' || to_json(response)::VARCHAR
    || ',"llm.usage.prompt_tokens":' || prompt_tokens::VARCHAR
    || ',"llm.usage.completion_tokens":' || completion_tokens::VARCHAR
    || ',"llm.usage.total_tokens":' || total_tokens::VARCHAR || '}'"""

LOG = """
log AS (
  SELECT event_id, ts, user_id,
    CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('purchase', 'signup') THEN 'response'
      ELSE 'request' END AS type,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'r' || (event_id - 1)::VARCHAR
      WHEN event_type <> 'error' THEN 'r' || event_id::VARCHAR END AS request_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
    CASE WHEN event_type NOT IN ('purchase', 'signup') THEN 'POST' END AS method,
    CASE WHEN event_type NOT IN ('purchase', 'signup')
      THEN '/v1/' || event_type || '/' || (user_id % 7)::VARCHAR END AS path,
    CASE WHEN event_type <> 'error' THEN props END AS body,
    CASE WHEN event_type IN ('purchase', 'signup')
      THEN CASE user_id % 10 WHEN 0 THEN 500 WHEN 1 THEN 401 ELSE 200 END END::BIGINT AS status_code,
    CASE WHEN event_type = 'error' THEN 'upstream'
      WHEN event_type = 'signup' AND user_id % 10 = 0 THEN 'timeout' END AS error,
    CASE WHEN event_type IN ('purchase', 'signup') AND value >= 1 THEN value END AS duration_ms
  FROM events
)"""

REWARDS = """
rewards AS (
  SELECT 'ro-' || lpad(doc_id::VARCHAR, 12, '0') AS rollout_id, max(quality)::DOUBLE AS reward FROM labels GROUP BY 1
)"""

EVENT_SPANS = """
event_spans AS (
  SELECT 'event.' || event_type AS name, md5(user_id::VARCHAR) AS trace_id, 'e' || event_id::VARCHAR AS span_id,
    CASE WHEN event_id % 4 <> 0 THEN 'e' || (event_id - 1)::VARCHAR END AS parent_id,
    epoch_us(ts) / 1e6 AS start_time, epoch_us(ts) / 1e6 + value / 1000 AS end_time,
    CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status, props AS attributes,
    'ro-u' || user_id::VARCHAR AS rollout_id, 'at-u' || user_id::VARCHAR AS attempt_id, event_id, ts, value
  FROM events
)"""


def shard_sql(seconds: str, minutes: int) -> str:
    """Midnight-anchored window label of an epoch-seconds expression."""
    width = minutes * 60
    day = f"make_timestamp((floor({seconds} / 86400) * 86400)::BIGINT * 1000000)"
    inside = f"(floor(({seconds} - floor({seconds} / 86400) * 86400) / {width}) * {width})::BIGINT"
    return f"strftime({day} + to_seconds({inside}), '%Y%m%d_%H%M%S')"


def models(spark: SparkSession, folder: str) -> DataFrame:
    """Model configuration for the models of the calls."""
    number = (F.col("conv_id") % 3).cast("string")
    target = F.when(number == "0", "openai/other").when(number == "1", "openai/Gemini-flash").otherwise("gemini/pro")
    return (
        table(spark, folder, "conversations")
        .select(
            F.concat(F.lit("model_"), number).alias("model_name"),
            F.struct(
                target.alias("model"),
                F.lit("https://models.example/v1").alias("api_base"),
                (number == "2").alias("drop_params"),
            ).alias("litellm_params"),
        )
        .distinct()
    )


RAW = (
    SPANS
    + """,
raw AS (
  SELECT *, 'c-' || conv_id::VARCHAR || '-' || turn::VARCHAR AS tool_id,
    'call-' || conv_id::VARCHAR || '-' || turn::VARCHAR AS call_id,
    turn = 7 AS failed, conv_id % 3 AS kind,
    substr(sha256('call-' || conv_id::VARCHAR || '-' || turn::VARCHAR), 33, 16) AS captured_id,
    '[' || array_to_string(list_concat(list_transform(messages, lambda m: to_json(m)::VARCHAR),
      CASE WHEN sequence_id % 2 = 1 THEN ['{"role":"tool","content":"result of c-' || conv_id::VARCHAR || '-' || turn::VARCHAR
        || '","tool_call_id":"c-' || conv_id::VARCHAR || '-' || turn::VARCHAR || '"}'] ELSE []::VARCHAR[] END), ',')
      || ']' AS stored
  FROM spans
),
captured AS (
  SELECT *,
    CASE WHEN failed THEN NULL WHEN kind = 0 AND turn % 4 = 1 THEN 'because ' || tool_id
      WHEN kind = 0 THEN 'because ' || tool_id WHEN kind = 2 THEN 'because ' || tool_id END AS reasoning,
    CASE WHEN failed THEN NULL WHEN kind = 0 THEN '[{"id":"' || tool_id || '","type":"function","function":{"name":"lookup",'
      || '"arguments":"{\\"q\\":' || turn::VARCHAR || '}"}}]'
      ELSE '[{"id":"' || tool_id || '","name":"lookup","input":{"q":' || turn::VARCHAR || '}}]' END AS tool_calls,
    CASE WHEN sequence_id % 2 = 1 THEN '[{"tool_call_id":"' || tool_id || '","content":"result of ' || tool_id || '"}]' END
      AS tool_results
  FROM raw
)"""
)
