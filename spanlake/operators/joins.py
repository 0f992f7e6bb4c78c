"""Joins of spans and records with other tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import attr, content_text
from .skew import join_unique

CALL_LIST = "ARRAY<STRUCT<id: STRING, name: STRING, function: STRUCT<name: STRING>>>"
RESULT_LIST = "ARRAY<STRUCT<tool_call_id: STRING, content: VARIANT>>"


def attach_reasoning(records: DataFrame, thoughts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fill a missing ``thought_chain`` from a table of thoughts. Of several thoughts for a key the
    largest text is taken, so that a record is never multiplied."""
    per_key = thoughts.groupBy(*keys).agg(F.max("thought_chain").alias("_thought"))
    joined = join_unique(records, per_key, keys)
    filled = F.coalesce("thought_chain", "_thought") if "thought_chain" in records.columns else F.col("_thought")
    columns = [c for c in records.columns if c != "thought_chain"]
    return joined.select(*columns, filled.alias("thought_chain"))


def tool_calls(spans: DataFrame) -> DataFrame:
    """One row per tool call of a response: rollout, span, call id and tool name."""
    listed = F.from_json(attr(F.col("attributes"), "llm.response.tool_calls"), CALL_LIST)
    return spans.select("rollout_id", "span_id", F.explode(listed).alias("call")).select(
        "rollout_id",
        "span_id",
        F.col("call.id").alias("tool_call_id"),
        F.coalesce("call.function.name", "call.name").alias("tool"),
    )


def tool_results(spans: DataFrame) -> DataFrame:
    """One row per rollout and call id: later requests repeat earlier results, so the first one counts."""
    listed = F.from_json(attr(F.col("attributes"), "llm.conversation.tool_results"), RESULT_LIST)
    exploded = spans.select("rollout_id", "span_id", "start_time", F.explode(listed).alias("result")).select(
        "rollout_id",
        F.col("result.tool_call_id").alias("tool_call_id"),
        F.struct("start_time", "span_id", content_text(F.col("result.content")).alias("content")).alias("seen"),
    )
    return (
        exploded.where(F.col("tool_call_id").isNotNull())
        .groupBy("rollout_id", "tool_call_id")
        .agg(F.min("seen").alias("seen"))
        .select(
            "rollout_id",
            "tool_call_id",
            F.col("seen.content").alias("result"),
            F.col("seen.span_id").alias("result_span_id"),
        )
    )


def join_tool_results(spans: DataFrame) -> DataFrame:
    """Every tool call with its result; null while there is none."""
    return join_unique(tool_calls(spans), tool_results(spans), ["rollout_id", "tool_call_id"])
