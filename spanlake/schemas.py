"""Schemas of the tables the package reads and writes, as DDL text."""

from __future__ import annotations

SPAN = (
    "name STRING, trace_id STRING, span_id STRING, parent_id STRING, start_time DOUBLE, end_time DOUBLE,"
    " kind STRING, status STRING, attributes STRING, rollout_id STRING, attempt_id STRING,"
    " sequence_id BIGINT, resource_attributes STRING"
)

# Attributes that the lake keeps as columns of their own, so that summaries do not read the JSON text.
PROMOTED = "model STRING, prompt_tokens BIGINT, completion_tokens BIGINT, total_tokens BIGINT, is_call BOOLEAN, has_response BOOLEAN"

PROMOTED_NAMES = tuple(c.split()[0] for c in PROMOTED.split(", "))

# Nested lists of a span that the 13 stored columns do not hold.
EVENTS = "ARRAY<STRUCT<name: STRING, timestamp: DOUBLE, attributes: MAP<STRING, VARIANT>>>"
LINKS = (
    "ARRAY<STRUCT<context: STRUCT<trace_id: STRING, span_id: STRING, trace_state: MAP<STRING, STRING>>,"
    " attributes: MAP<STRING, VARIANT>>>"
)

LOG = (
    "type STRING, request_id STRING, timestamp STRING, method STRING, path STRING,"
    " headers MAP<STRING, STRING>, body STRING, status_code INT, error STRING, request_method STRING,"
    " request_path STRING, duration_ms DOUBLE, _corrupt_record STRING"
)

SFT = (
    "id STRING, prompt STRING, response STRING, thought_chain STRING, model STRING, rollout_id STRING,"
    " timestamp DOUBLE, metadata STRING, prompt_tokens BIGINT, completion_tokens BIGINT, total_tokens BIGINT"
)

RL = (
    "rollout_id STRING, attempt_id STRING, trajectory STRING, reward DOUBLE, query STRING, response STRING,"
    " model STRING, timestamp DOUBLE, metadata STRING, part BIGINT"
)

REWARD = "prompt STRING, chosen STRING, rejected STRING"

RAW_CALL = (
    "call_id STRING, kwargs STRING, response STRING, error STRING, start_time DOUBLE, end_time DOUBLE"
)

MODEL = "STRUCT<model_name: STRING, litellm_params: STRUCT<model: STRING, api_base: STRING, drop_params: BOOLEAN>>"

# Span kinds and span states.
SPAN_KINDS = ("INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
SPAN_STATUSES = ("UNSET", "OK", "ERROR")
