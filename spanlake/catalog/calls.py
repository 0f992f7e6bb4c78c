"""Registered queries on raw calls: capture, sanitizing, tool joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import with_attrs
from ..operators import capture as ops, joins, sanitize
from . import fixtures as fx
from .registry import registry

QUERIES, ORACLE, query = registry()


def _parsed(spark, folder):
    return ops.parse_calls(fx.raw_calls(spark, folder))


@query("request_messages", f"WITH {fx.RAW} SELECT call_id, stored AS messages FROM raw")
def request_messages(spark, folder):
    return _parsed(spark, folder).select("call_id", ops.stored_messages().alias("messages"))


@query("system_split", f"WITH {fx.RAW} SELECT call_id, system FROM raw")
def system_split(spark, folder):
    return _parsed(spark, folder).select("call_id", ops.system_prompt().alias("system"))


@query("tool_results", f"WITH {fx.RAW} SELECT call_id, tool_results FROM captured")
def tool_results(spark, folder):
    return _parsed(spark, folder).select("call_id", ops.tool_results().alias("tool_results"))


@query(
    "request_model_and_params",
    f"""WITH {fx.RAW} SELECT call_id, model, CASE WHEN turn % 2 = 1 THEN '0.5' END AS temperature,
    CASE WHEN conv_id % 2 = 0 THEN '256' END AS max_tokens, NULL::VARCHAR AS top_p,
    CASE WHEN conv_id % 5 = 0 THEN '[{{"type":"function","name":"lookup"}}]' END AS tools
    FROM raw""",
)
def request_model_and_params(spark, folder):
    return _parsed(spark, folder).select(
        "call_id",
        ops.model_name().alias("model"),
        *[
            F.to_json(F.struct(ops.request_param(p).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(ops.request_param(p).alias("v"))))).alias(f"_{p}")
            for p in ("temperature", "max_tokens", "top_p")
        ],
        ops.request_tools().alias("tools"),
    ).select(
        "call_id",
        "model",
        *[
            F.nullif(F.regexp_replace(f"_{p}", r"\}$", ""), F.lit("")).alias(p)
            for p in ("temperature", "max_tokens", "top_p")
        ],
        "tools",
    )


@query(
    "response_shape",
    f"""WITH {fx.RAW} SELECT CASE WHEN failed THEN 'none' WHEN kind = 0 THEN 'chat' WHEN kind = 1 THEN 'blocks'
    ELSE 'output' END AS shape, count(*) AS calls FROM raw GROUP BY 1""",
)
def response_shape(spark, folder):
    shape = F.coalesce("shape", F.lit("none")).alias("shape")
    return _parsed(spark, folder).groupBy(shape).agg(F.count("*").alias("calls"))


def _content(shape: str, number: int, column):
    name = f"content_{shape}"
    sql = f"WITH {fx.RAW} SELECT call_id, response AS content FROM raw WHERE kind = {number} AND NOT failed"

    @query(name, sql)
    def content(spark, folder):
        return _parsed(spark, folder).where(F.col("shape") == shape).select("call_id", column().alias("content"))


_content("chat", 0, ops.content_chat)
_content("blocks", 1, ops.content_blocks)
_content("output", 2, ops.content_output)


@query("response_tool_calls", f"WITH {fx.RAW} SELECT call_id, tool_calls FROM captured")
def response_tool_calls(spark, folder):
    return _parsed(spark, folder).select("call_id", ops.response_tool_calls().alias("tool_calls"))


@query("response_reasoning", f"WITH {fx.RAW} SELECT call_id, reasoning FROM captured")
def response_reasoning(spark, folder):
    return _parsed(spark, folder).select("call_id", ops.response_reasoning().alias("reasoning"))


@query(
    "response_usage",
    f"""WITH {fx.RAW} SELECT call_id, CASE WHEN NOT failed THEN prompt_tokens END AS prompt_tokens,
    CASE WHEN NOT failed THEN completion_tokens END AS completion_tokens,
    CASE WHEN NOT failed THEN 0::BIGINT END AS other_tokens FROM raw""",
)
def response_usage(spark, folder):
    return _parsed(spark, folder).select(
        "call_id",
        ops.usage("prompt_tokens").alias("prompt_tokens"),
        ops.usage("completion_tokens").alias("completion_tokens"),
        ops.usage("other_tokens").alias("other_tokens"),
    )


@query(
    "response_token_ids",
    f"""WITH {fx.RAW} SELECT call_id,
    CASE WHEN kind = 0 AND NOT failed THEN '[' || turn::VARCHAR || ', ' || conv_id::VARCHAR || ']' END AS token_ids,
    CASE WHEN kind = 0 AND NOT failed THEN '[1, 2]' END AS prompt_token_ids FROM raw""",
)
def response_token_ids(spark, folder):
    return _parsed(spark, folder).select(
        "call_id",
        ops.provider_token_ids().alias("token_ids"),
        ops.prompt_token_ids().alias("prompt_token_ids"),
    )


_PROMOTED = {
    "model": "llm.model",
    "messages": "llm.request.messages",
    "system": "llm.request.system",
    "response": "llm.response.content",
    "reasoning": "llm.response.reasoning",
    "total_tokens": "llm.usage.total_tokens",
    "error": "llm.error",
}


def captured_columns(spans):
    return with_attrs(spans, **_PROMOTED).select(
        "span_id", "rollout_id", "attempt_id", "sequence_id", "start_time", "end_time", "status", "kind", *_PROMOTED
    )


CAPTURED = f"""WITH {fx.RAW} SELECT captured_id AS span_id, rollout_id, attempt_id, sequence_id, start_time, end_time,
    CASE WHEN failed THEN 'ERROR' ELSE 'OK' END AS status, 'CLIENT' AS kind, model, stored AS messages, system,
    CASE WHEN NOT failed THEN response END AS response, reasoning,
    CASE WHEN NOT failed THEN total_tokens END AS total_tokens,
    CASE WHEN failed AND conv_id % 2 = 0 THEN 'upstream' WHEN failed THEN 'Unknown error' END AS error FROM captured"""


@query("capture_spans", CAPTURED)
def capture_spans(spark, folder):
    return captured_columns(ops.build_spans(fx.raw_calls(spark, folder)))


@query("capture_success", f"SELECT * FROM ({CAPTURED}) WHERE status = 'OK'")
def capture_success(spark, folder):
    answered = fx.raw_calls(spark, folder).where(F.col("response").isNotNull())
    return captured_columns(ops.build_success(answered))


@query("capture_failure", f"SELECT * FROM ({CAPTURED}) WHERE status = 'ERROR'")
def capture_failure(spark, folder):
    failed = fx.raw_calls(spark, folder).where(F.col("response").isNull())
    return captured_columns(ops.build_failure(failed))


@query(
    "capture_attribute_keys",
    f"""WITH {fx.RAW}, present AS (SELECT unnest(list_filter([
      'llm.model', 'llm.request.messages',
      CASE WHEN system IS NOT NULL THEN 'llm.request.system' END,
      CASE WHEN NOT failed AND turn % 2 = 1 THEN 'llm.request.temperature' END,
      CASE WHEN NOT failed AND conv_id % 2 = 0 THEN 'llm.request.max_tokens' END,
      CASE WHEN NOT failed AND conv_id % 5 = 0 THEN 'llm.request.tools' END,
      CASE WHEN NOT failed THEN 'llm.response.content' END,
      CASE WHEN reasoning IS NOT NULL THEN 'llm.response.reasoning' END,
      CASE WHEN tool_calls IS NOT NULL THEN 'llm.response.tool_calls' END,
      CASE WHEN NOT failed AND kind = 0 THEN 'llm.provider.token_ids' END,
      CASE WHEN NOT failed THEN 'llm.usage.prompt_tokens' END,
      CASE WHEN NOT failed THEN 'llm.usage.completion_tokens' END,
      CASE WHEN NOT failed THEN 'llm.usage.total_tokens' END,
      CASE WHEN NOT failed AND kind = 0 THEN 'llm.prompt_token_ids' END,
      CASE WHEN NOT failed AND tool_results IS NOT NULL THEN 'llm.conversation.tool_results' END,
      CASE WHEN failed THEN 'llm.error' END], lambda k: k IS NOT NULL)) AS key FROM captured)
    SELECT key, count(*) AS calls FROM present GROUP BY key""",
)
def capture_attribute_keys(spark, folder):
    spans = ops.build_spans(fx.raw_calls(spark, folder))
    keys = spans.select(F.explode(F.json_object_keys("attributes")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("calls"))


@query(
    "capture_quarantine",
    f"""WITH {fx.RAW} SELECT CASE WHEN turn % 8 IN (1, 3, 5) THEN 'bad' ELSE 'good' END AS state, count(*) AS calls,
    min(call_id) AS first_call FROM raw GROUP BY 1""",
)
def capture_quarantine(spark, folder):
    turn = F.split("call_id", "-")[2].cast("int") % 8
    spoiled = (
        F.when(turn == 1, F.substring("kwargs", 2, F.length("kwargs")))
        .when(turn == 3, '{"model":"m","messages":null}')
        .when(turn == 5, '{"model":"m","messages":["text"]}')
        .otherwise(F.col("kwargs"))
    )
    good, bad = ops.split_malformed(fx.raw_calls(spark, folder).withColumn("kwargs", spoiled))
    both = good.withColumn("state", F.lit("good")).unionByName(bad.withColumn("state", F.lit("bad")))
    return both.groupBy("state").agg(F.count("*").alias("calls"), F.min("call_id").alias("first_call"))


def _sanitizable(spark, folder):
    calls = fx.calls(spark, folder)
    data = F.struct(
        F.col("turn").alias("n"),
        F.lit(0.5).alias("temperature"),
        F.lit("auto").alias("tool_choice"),
        F.array(F.lit("lookup")).alias("tools"),
        F.when(F.col("turn") % 3 == 0, F.lit(True)).alias("parallel_tool_calls"),
    )
    kwargs = F.when(F.col("turn") % 2 == 1, F.to_json(F.struct("model", data.alias("data")))).otherwise(
        F.to_json(F.struct(data.alias("data"), F.struct("model").alias("litellm_params")))
    )
    return calls.select("rollout_id", "sequence_id", "model", kwargs.alias("kwargs"))


@query(
    "sanitize_requests",
    f"""WITH {fx.CALLS}, parts AS (SELECT rollout_id, sequence_id, turn, model,
    '{{"n":' || turn::VARCHAR || ',"temperature":0.5' || CASE WHEN model = 'model_0' THEN ',"tool_choice":"auto","tools":["lookup"]'
      || CASE WHEN turn % 3 = 0 THEN ',"parallel_tool_calls":true' ELSE '' END ELSE '' END || '}}' AS data FROM calls)
    SELECT rollout_id, sequence_id, CASE WHEN turn % 2 = 1 THEN '{{"model":"' || model || '","data":' || data || '}}'
    ELSE '{{"data":' || data || ',"litellm_params":{{"model":"' || model || '"}}}}' END AS kwargs FROM parts""",
)
def sanitize_requests(spark, folder):
    done = sanitize.sanitize_requests(_sanitizable(spark, folder), fx.models(spark, folder))
    return done.select("rollout_id", "sequence_id", "kwargs")


@query(
    "sanitize_model_set",
    """SELECT DISTINCT 'model_' || (conv_id % 3)::VARCHAR AS prefix FROM conversations WHERE conv_id % 3 <> 0""",
)
def sanitize_model_set(spark, folder):
    return sanitize.sanitize_model_set(fx.models(spark, folder))


@query(
    "match_model_prefix",
    f"""WITH {fx.CALLS} SELECT conv_id, turn, model, conv_id % 3 <> 0 AS matched FROM calls""",
)
def match_model_prefix(spark, folder):
    """The models of the calls against those whose requests need sanitizing."""
    listed = sanitize.sanitize_model_set(fx.models(spark, folder))
    return sanitize.match_model_prefix(fx.calls(spark, folder), listed).select("conv_id", "turn", "model", "matched")


_PREFIXES = """WITH p AS (SELECT DISTINCT 'model_' || conv_id::VARCHAR AS prefix FROM conversations WHERE conv_id % 2 = 1)
    SELECT conv_id, turn, EXISTS (SELECT 1 FROM p WHERE starts_with('model_' || c.conv_id::VARCHAR || '-chat', p.prefix)) AS matched
    FROM conversations c"""


def _prefixed(spark, folder, **options):
    """A model name per conversation against a prefix of every second one; the list grows with the table."""
    told = fx.table(spark, folder, "conversations")
    number = lambda n: F.concat(F.lit("model_"), n.cast("string"))
    prefixes = told.where("conv_id % 2 = 1").select(number(F.col("conv_id")).alias("prefix"))
    named = told.select("conv_id", "turn", F.concat(number(F.col("conv_id")), F.lit("-chat")).alias("model"))
    return sanitize.match_model_prefix(named, prefixes, **options).select("conv_id", "turn", "matched")


@query("match_model_prefix_long_list", _PREFIXES)
def match_model_prefix_long_list(spark, folder):
    return _prefixed(spark, folder)


@query("match_model_prefix_joined", _PREFIXES)
def match_model_prefix_joined(spark, folder):
    """The same by joins, as a list takes them that is too long for the plan."""
    return _prefixed(spark, folder, in_plan=3)


@query(
    "join_tool_results",
    f"""WITH {fx.RAW} SELECT rollout_id, captured_id AS span_id, tool_id AS tool_call_id, 'lookup' AS tool,
    CASE WHEN tool_results IS NOT NULL THEN 'result of ' || tool_id END AS result,
    CASE WHEN tool_results IS NOT NULL THEN captured_id END AS result_span_id FROM captured WHERE NOT failed""",
)
def join_tool_results(spark, folder):
    return joins.join_tool_results(fx.captured(spark, folder))
