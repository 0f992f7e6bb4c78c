"""Raw calls -> spans. Set-oriented column expressions over a table or stream of raw calls.

A raw call holds the request arguments and the response as JSON text (``schemas.RAW_CALL``). Each of
the two texts is parsed once per row; everything else is built from the parsed structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import call_ids, content_text, with_default_ids
from ..functions.texts import MESSAGES

BLOCK = "STRUCT<type: STRING, text: STRING, id: STRING, name: STRING, input: VARIANT>"
TOOL_CALL = "STRUCT<id: STRING, type: STRING, function: STRUCT<name: STRING, arguments: STRING>>"
RESPONSE = (
    f"STRUCT<output: ARRAY<STRUCT<type: STRING, content: ARRAY<{BLOCK}>>>,"
    " choices: ARRAY<STRUCT<message: STRUCT<content: STRING, reasoning_content: STRING,"
    f" tool_calls: ARRAY<{TOOL_CALL}>>, provider_specific_fields: MAP<STRING, STRING>>>,"
    f" content: ARRAY<{BLOCK}>, usage: MAP<STRING, STRING>, prompt_token_ids: STRING>"
)
REQUEST = (
    "STRUCT<messages: STRING, model: STRING, temperature: VARIANT, max_tokens: VARIANT, top_p: VARIANT,"
    " tools: STRING>"
)

# Span name, provider default, error default, JSON texts that count as absent.
SPAN_NAME = "llm.completion"
PROVIDER = "litellm"
UNKNOWN_ERROR = "Unknown error"
EMPTY_JSON = ("", "[]", "{}", "null", "false", "0")

SERVICE_NAME = "spanlake"
_WITH_NULLS = {"ignoreNullFields": "false"}


def request_payload(kwargs: Column, hook_data: Column | None = None) -> Column:
    """The JSON object that holds the messages: chosen by which key is present, in fixed order."""
    keys = F.json_object_keys(kwargs)
    data = F.get_json_object(kwargs, "$.data")
    fallback = F.lit("{}") if hook_data is None else F.coalesce(hook_data, F.lit("{}"))
    return (
        F.when(F.array_contains(keys, "messages"), kwargs)
        .when(F.array_contains(keys, "litellm_params"), F.get_json_object(kwargs, "$.litellm_params"))
        .when(data.startswith("{"), data)
        .otherwise(fallback)
    )


def parse_calls(raw: DataFrame) -> DataFrame:
    """Add the parsed request (``req``), its message list and texts, and the parsed response (``resp``)."""
    hook_data = F.col("hook_data") if "hook_data" in raw.columns else None
    return (
        raw.withColumn("req", F.from_json(request_payload(F.col("kwargs"), hook_data), REQUEST))
        .withColumn("msgs", F.coalesce(F.from_json("req.messages", MESSAGES), F.array().cast(MESSAGES)))
        .withColumn("msg_texts", F.coalesce(F.from_json("req.messages", "ARRAY<STRING>"), F.array().cast("ARRAY<STRING>")))
        .withColumn("resp", F.from_json("response", RESPONSE))
        .withColumn("shape", response_shape(F.col("resp")))
    )


def split_malformed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls that can become spans, and the quarantine: arguments that are not a JSON object, messages
    that are not a list of objects, or a missing start time."""
    hook_data = F.col("hook_data") if "hook_data" in raw.columns else None
    messages = F.from_json(request_payload(F.col("kwargs"), hook_data), "messages VARIANT")["messages"]
    objects = F.forall(F.try_variant_get(messages, "$", "ARRAY<MAP<STRING, VARIANT>>"), lambda m: m.isNotNull())
    fine = (
        F.json_object_keys("kwargs").isNotNull()
        & F.col("start_time").isNotNull()
        & (messages.isNull() | F.coalesce(objects, F.lit(False)))
    )
    return raw.where(fine), raw.where(~fine)


# --- request side -----------------------------------------------------------------------------


def _leading_system() -> Column:
    return F.coalesce(F.get("msgs", F.lit(0))["role"] == "system", F.lit(False))


def system_prompt() -> Column:
    """Content of a leading system turn; null without one or when its content is null."""
    return F.when(_leading_system(), content_text(F.get("msgs", F.lit(0))["content"]))


def stored_messages() -> Column:
    """The messages as JSON text without the leading system turn; every message keeps all its keys."""
    rest = F.when(_leading_system(), F.slice("msg_texts", F.lit(2), F.size("msg_texts"))).otherwise(F.col("msg_texts"))
    return F.concat(F.lit("["), F.array_join(rest, ","), F.lit("]"))


def tool_results() -> Column:
    """``[{tool_call_id, content}]`` of the tool turns, from the full list; null without any."""
    found = F.transform(
        F.filter("msgs", lambda m: m["role"] == "tool"),
        lambda m: F.struct(m["tool_call_id"].alias("tool_call_id"), m["content"].alias("content")),
    )
    return F.when(F.size(found) > 0, F.to_json(found, _WITH_NULLS))


def model_name() -> Column:
    return F.coalesce(F.get_json_object("kwargs", "$.model"), F.col("req.model"), F.lit("unknown"))


def request_param(name: str) -> Column:
    """A numeric parameter as the JSON number it was; null when it is absent or JSON null."""
    value = F.col(f"req.{name}")
    return F.when(~F.is_variant_null(value), value)


def request_tools() -> Column:
    return F.when(~F.col("req.tools").isin(*EMPTY_JSON), F.col("req.tools"))


# --- response side ----------------------------------------------------------------------------


def response_shape(resp: Column) -> Column:
    """``output`` before ``chat`` before ``blocks``, by which list is non-empty; else null."""
    return (
        F.when(F.size(resp["output"]) > 0, "output")
        .when(F.size(resp["choices"]) > 0, "chat")
        .when(F.size(resp["content"]) > 0, "blocks")
    )


def _choice() -> Column:
    return F.get("resp.choices", F.lit(0))


def content_chat() -> Column:
    text = _choice()["message"]["content"]
    return F.when(F.length(text) > 0, text)


def _joined(texts: Column) -> Column:
    return F.when(F.size(texts) > 0, F.array_join(texts, ""))


def _tool_uses(blocks: Column) -> Column:
    """``[{id, name, input}]`` of the tool blocks as JSON text; null without any."""
    uses = F.transform(
        F.filter(blocks, lambda b: b["type"] == "tool_use"),
        lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), b["input"].alias("input")),
    )
    return F.when(F.size(uses) > 0, F.to_json(uses, _WITH_NULLS))


def content_blocks() -> Column:
    """Concatenated ``text`` blocks."""
    blocks = F.filter("resp.content", lambda b: b["type"] == "text")
    return _joined(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))))


def _output_parts(reasoning: bool) -> Column:
    """Content parts of the reasoning items, or of the message items that are not reasoning."""

    def wanted(item: Column) -> Column:
        kind = F.lower(F.coalesce(item["type"], F.lit("")))
        is_reasoning = kind.contains("reasoning")
        return is_reasoning if reasoning else ~is_reasoning & kind.contains("message")

    items = F.filter("resp.output", wanted)
    empty = F.array().cast(f"ARRAY<{BLOCK}>")
    return F.flatten(F.transform(items, lambda i: F.coalesce(i["content"], empty)))


def content_output() -> Column:
    parts = F.filter(_output_parts(False), lambda p: (p["type"] == "output_text") & (F.length(p["text"]) > 0))
    return _joined(F.transform(parts, lambda p: p["text"]))


def reasoning_output() -> Column:
    parts = F.filter(_output_parts(True), lambda p: p["text"].isNotNull())
    return _joined(F.transform(parts, lambda p: p["text"]))


def response_content() -> Column:
    shape = F.col("shape")
    return (
        F.when(shape == "output", content_output())
        .when(shape == "chat", content_chat())
        .when(shape == "blocks", content_blocks())
    )


def response_tool_calls() -> Column:
    shape = F.col("shape")
    chat = _choice()["message"]["tool_calls"]
    return (
        F.when(shape == "output", _tool_uses(_output_parts(False)))
        .when(shape == "chat", F.when(F.size(chat) > 0, F.to_json(chat, _WITH_NULLS)))
        .when(shape == "blocks", _tool_uses(F.col("resp.content")))
    )


def response_reasoning() -> Column:
    shape = F.col("shape")
    choice = _choice()
    own = choice["message"]["reasoning_content"]
    provider = F.try_element_at(choice["provider_specific_fields"], F.lit("reasoning"))
    return F.when(shape == "output", reasoning_output()).when(
        shape == "chat", F.coalesce(F.nullif(own, F.lit("")), F.nullif(provider, F.lit("")))
    )


def usage(name: str) -> Column:
    """A usage counter: 0 when the usage lacks it, null when there is no usage."""
    counter = F.try_element_at("resp.usage", F.lit(name)).try_cast("bigint")
    return F.when(F.size("resp.usage") > 0, F.coalesce(counter, F.lit(0).cast("bigint")))


def _spaced(ids: Column) -> Column:
    return F.replace(ids, F.lit(","), F.lit(", "))


def provider_token_ids() -> Column:
    """Token ids of the provider as ``[1, 2]``; ``[]`` when its fields lack them, null without fields."""
    fields = _choice()["provider_specific_fields"]
    ids = F.try_element_at(fields, F.lit("token_ids"))
    return F.when((F.col("shape") == "chat") & (F.size(fields) > 0), _spaced(F.coalesce(ids, F.lit("[]"))))


def prompt_token_ids() -> Column:
    return _spaced(F.col("resp.prompt_token_ids"))


# --- spans ------------------------------------------------------------------------------------


def _success_attributes() -> Column:
    return F.to_json(
        F.struct(
            model_name().alias("llm.model"),
            stored_messages().alias("llm.request.messages"),
            system_prompt().alias("llm.request.system"),
            request_param("temperature").alias("llm.request.temperature"),
            request_param("max_tokens").alias("llm.request.max_tokens"),
            request_param("top_p").alias("llm.request.top_p"),
            request_tools().alias("llm.request.tools"),
            response_content().alias("llm.response.content"),
            response_reasoning().alias("llm.response.reasoning"),
            response_tool_calls().alias("llm.response.tool_calls"),
            provider_token_ids().alias("llm.provider.token_ids"),
            usage("prompt_tokens").alias("llm.usage.prompt_tokens"),
            usage("completion_tokens").alias("llm.usage.completion_tokens"),
            usage("total_tokens").alias("llm.usage.total_tokens"),
            prompt_token_ids().alias("llm.prompt_token_ids"),
            tool_results().alias("llm.conversation.tool_results"),
        )
    )


def _failure_attributes() -> Column:
    error = F.coalesce(F.nullif(F.col("error"), F.lit("")), F.nullif(F.col("response"), F.lit("")), F.lit(UNKNOWN_ERROR))
    return F.to_json(
        F.struct(
            model_name().alias("llm.model"),
            stored_messages().alias("llm.request.messages"),
            error.alias("llm.error"),
            system_prompt().alias("llm.request.system"),
        )
    )


def _as_spans(raw: DataFrame, attributes: Column, status: Column, service_name: str) -> DataFrame:
    trace_id, span_id = call_ids(F.col("call_id"))
    provider = F.coalesce(F.get_json_object("kwargs", "$.provider"), F.lit(PROVIDER))
    sequence = F.col("sequence_id") if "sequence_id" in raw.columns else F.lit(0)
    spans = with_default_ids(parse_calls(raw), ["call_id"])
    return spans.select(
        F.lit(SPAN_NAME).alias("name"),
        trace_id.alias("trace_id"),
        span_id.alias("span_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.col("start_time").cast("double").alias("start_time"),
        F.col("end_time").cast("double").alias("end_time"),
        F.lit("CLIENT").alias("kind"),
        status.alias("status"),
        attributes.alias("attributes"),
        "rollout_id",
        "attempt_id",
        sequence.cast("bigint").alias("sequence_id"),
        F.to_json(F.struct(F.lit(service_name).alias("service.name"), provider.alias("llm.provider"))).alias(
            "resource_attributes"
        ),
    )


def build_success(raw: DataFrame, service_name: str = SERVICE_NAME) -> DataFrame:
    """Spans of calls that succeeded."""
    return _as_spans(raw, _success_attributes(), F.lit("OK"), service_name)


def build_failure(raw: DataFrame, service_name: str = SERVICE_NAME) -> DataFrame:
    """Spans of calls that failed: the conversation and the error text only."""
    return _as_spans(raw, _failure_attributes(), F.lit("ERROR"), service_name)


def build_spans(raw: DataFrame, service_name: str = SERVICE_NAME) -> DataFrame:
    """Spans of all calls in one projection; a call with an error or without a response has failed."""
    failed = F.col("error").isNotNull() | F.col("response").isNull()
    attributes = F.when(failed, _failure_attributes()).otherwise(_success_attributes())
    return _as_spans(raw, attributes, F.when(failed, "ERROR").otherwise("OK"), service_name)
