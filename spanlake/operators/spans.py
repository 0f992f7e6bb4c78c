"""Operators on the flat span table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions import attr, duration, flatten_content, truncate_text, with_attrs
from .ordinals import group_ordinal

GROUP = ("rollout_id", "attempt_id")
SPAN_ORDER = ("start_time", "sequence_id", "span_id")


def flatten_span(nested: DataFrame) -> DataFrame:
    """Nested span -> the 13 stored columns; attribute maps become JSON text.

    Events, links and the trace state have no place in the stored columns.
    """
    kept = {"ignoreNullFields": "false"}
    return nested.select(
        "name",
        F.col("context.trace_id").alias("trace_id"),
        F.col("context.span_id").alias("span_id"),
        "parent_id",
        "start_time",
        "end_time",
        "kind",
        "status",
        F.coalesce(F.to_json("attributes", kept), F.lit("{}")).alias("attributes"),
        "rollout_id",
        "attempt_id",
        "sequence_id",
        F.coalesce(F.to_json("resource.attributes", kept), F.lit("{}")).alias("resource_attributes"),
    )


def nest_span(spans: DataFrame) -> DataFrame:
    """Stored columns -> nested span, with the defaults of a fresh span for what is missing."""
    variants = "MAP<STRING, VARIANT>"

    def as_map(text: str) -> Column:
        return F.coalesce(F.from_json(text, variants), F.from_json(F.lit("{}"), variants))

    return spans.select(
        "name",
        F.struct(
            "trace_id", "span_id", F.create_map().cast("MAP<STRING, STRING>").alias("trace_state")
        ).alias("context"),
        "parent_id",
        "start_time",
        "end_time",
        F.coalesce("kind", F.lit("INTERNAL")).alias("kind"),
        F.coalesce("status", F.lit("UNSET")).alias("status"),
        as_map("attributes").alias("attributes"),
        F.array().cast(schemas.EVENTS).alias("events"),
        F.array().cast(schemas.LINKS).alias("links"),
        F.struct(as_map("resource_attributes").alias("attributes")).alias("resource"),
        "rollout_id",
        "attempt_id",
        F.coalesce("sequence_id", F.lit(0)).cast("bigint").alias("sequence_id"),
    )


def _span_is_valid() -> Column:
    required = ("name", "trace_id", "span_id", "start_time", "rollout_id", "attempt_id")
    checks = [F.col(c).isNotNull() for c in required]
    checks.append(F.coalesce("kind", F.lit("INTERNAL")).isin(*schemas.SPAN_KINDS))
    checks.append(F.coalesce("status", F.lit("UNSET")).isin(*schemas.SPAN_STATUSES))
    # Text that is not a JSON object gives a null map.
    checks.append(F.col("attributes").isNull() | F.from_json("attributes", "MAP<STRING, STRING>").isNotNull())
    return reduce(lambda a, b: a & b, checks)


def validate_spans(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the span rules, and the others. The two parts add up to the input."""
    return spans.where(_span_is_valid()), spans.where(~_span_is_valid())


def with_duration(spans: DataFrame) -> DataFrame:
    return spans.withColumn("duration", duration(F.col("start_time"), F.col("end_time")))


def _first_by_time(spans: DataFrame, n: int, order: Sequence[Column], newest: bool = False) -> DataFrame:
    """The first ``n`` rows of an order that begins with the start time.

    On a lake the n-th time is looked up first, from the narrow columns alone. The rows up to it, of
    which the scan reads few row groups, are then put in order.
    """
    if "is_call" in spans.columns:
        at = F.col("start_time")
        edge = spans.select("start_time").orderBy(order[0]).limit(n)
        found = edge.agg(F.count("start_time").alias("n"), F.min(at).alias("low"), F.max(at).alias("high")).first()
        if found["n"] == n > 0:
            spans = spans.where(at >= found["low"]) if newest else spans.where(at <= found["high"])
    return spans.orderBy(*order).limit(n)


def query_spans(
    spans: DataFrame, rollout_id: str | None = None, attempt_id: str | None = None, limit: int = 100
) -> DataFrame:
    """Spans of a rollout and/or attempt, the first ``limit`` by time. Both filters reach the scan."""
    if rollout_id is not None:
        spans = spans.where(F.col("rollout_id") == rollout_id)
    if attempt_id is not None:
        spans = spans.where(F.col("attempt_id") == attempt_id)
    return _first_by_time(spans, limit, [F.col(c).asc_nulls_last() for c in SPAN_ORDER])


def llm_calls(spans: DataFrame) -> DataFrame:
    """Spans that carry request messages; the text of a message is not mistaken for the key."""
    if "is_call" in spans.columns:
        return spans.where("is_call")
    return spans.where(attr(F.col("attributes"), "llm.request.messages").isNotNull())


def earliest(spans: DataFrame, n: int = 5) -> DataFrame:
    return _first_by_time(llm_calls(spans), n, [F.col("start_time").asc_nulls_last(), F.col("span_id")])


def latest(spans: DataFrame, n: int = 5) -> DataFrame:
    return _first_by_time(llm_calls(spans), n, [F.col("start_time").desc(), F.col("span_id")], newest=True)


def call_view(spans: DataFrame) -> DataFrame:
    """What the call viewer shows for each call, as columns."""
    calls = with_attrs(
        llm_calls(spans),
        model="llm.model",
        system="llm.request.system",
        messages="llm.request.messages",
        reasoning="llm.response.reasoning",
        response="llm.response.content",
        prompt_tokens="llm.usage.prompt_tokens",
        completion_tokens="llm.usage.completion_tokens",
        total_tokens="llm.usage.total_tokens",
    )
    shown = F.transform(
        flatten_content(F.col("messages"), width=500),
        lambda m: F.concat(F.lit("["), m["role"], F.lit("]: "), m["content"]),
    )
    return calls.select(
        "span_id",
        F.date_format(F.timestamp_seconds("start_time"), "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.coalesce("model", F.lit("unknown")).alias("model"),
        F.round(duration(F.col("start_time"), F.col("end_time")) * 1000).cast("bigint").alias("duration_ms"),
        "status",
        truncate_text(F.col("system"), 300).alias("system"),
        F.array_join(shown, "\n").alias("input"),
        truncate_text(F.col("reasoning"), 500).alias("reasoning"),
        F.when(F.length("response") > 0, truncate_text(F.col("response"), 1000))
        .otherwise("(empty response)")
        .alias("response"),
        F.when(F.col("total_tokens") != 0, F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
        F.when(F.col("total_tokens") != 0, F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"),
        F.when(F.col("total_tokens") != 0, F.col("total_tokens")).alias("total_tokens"),
    )


def token_totals(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums of the three token counters, of a frame that has them as columns or as span attributes."""
    counters = ("prompt_tokens", "completion_tokens", "total_tokens")
    wanted = {c: f"llm.usage.{c}" for c in counters}
    if "model" in by:
        wanted["model"] = "llm.model"
    records = with_attrs(records, **wanted)
    return records.groupBy(*by).agg(*[F.sum(c).cast("bigint").alias(c) for c in counters])


def with_sequence(spans: DataFrame) -> DataFrame:
    """Number the spans of each attempt from 0 in time order."""
    return group_ordinal(spans.drop("sequence_id"), GROUP, ("start_time", "span_id"), "sequence_id")


def trajectory_ends(spans: DataFrame) -> DataFrame:
    """First and last span of each trajectory: an aggregate with map-side combine, no window."""
    place = F.struct("sequence_id", "start_time", "span_id")
    whole = F.struct("span_id", "start_time", "end_time", "attributes")
    return spans.groupBy(*GROUP).agg(
        F.min_by(whole, place).alias("first"), F.max_by(whole, place).alias("last"), F.count("*").alias("spans")
    )


def union_spans(*frames: DataFrame) -> DataFrame:
    """Concatenate, columns aligned by name; a column some frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
