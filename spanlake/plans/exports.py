"""Training sets from spans: record building and the export formats.

Every format is a function ``DataFrame -> DataFrame`` listed in ``FORMATS``, so a new one is added
by registering it; :func:`export` only looks it up and writes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import attr, last_content, with_attrs
from ..operators.ordinals import global_ordinal, group_ordinal
from ..operators.skew import heavy_keys, join_unique, split_heavy
from ..operators.spans import GROUP, llm_calls
from ..sinks import export_parquet, export_splits
from ..sources import read_records

# Spans in one trajectory row. Longer trajectories continue in further rows (``part``).
TRAJECTORY_PART = 1024

_TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens")


def _filled(value: str, default: str = "") -> Column:
    return F.coalesce(F.col(value), F.lit(default))


def _nonempty(value: Column) -> Column:
    return F.when(F.length(value) > 0, value)


# --- records ----------------------------------------------------------------------------------


def spans_to_sft(spans: DataFrame) -> DataFrame:
    """One SFT record per successful call with a response; the prompt is the last user message.

    On a lake read with its promoted columns all three conditions are filters on columns.
    """
    answered = llm_calls(spans.where(F.col("status") == "OK"))
    if "has_response" in spans.columns:
        answered = answered.where("has_response")
    else:
        answered = answered.where(F.length(attr(F.col("attributes"), "llm.response.content")) > 0)
    calls = with_attrs(
        answered,
        messages="llm.request.messages",
        response="llm.response.content",
        thought_chain="llm.response.reasoning",
        model="llm.model",
        **{c: f"llm.usage.{c}" for c in _TOKENS},
    )
    return calls.select(
        F.col("span_id").alias("id"),
        F.coalesce(last_content(F.col("messages")), F.lit("")).alias("prompt"),
        "response",
        "thought_chain",
        "model",
        "rollout_id",
        F.col("start_time").alias("timestamp"),
        F.to_json(F.struct("attempt_id", "sequence_id", "trace_id")).alias("metadata"),
        *_TOKENS,
    )


_SPAN_FIELDS = ("span_id", "start_time", "end_time", "kind", "status", "sequence_id", "attributes")


def _trajectory_parts(spans: DataFrame, heavy: list[int], part_spans: int) -> DataFrame:
    """Trajectory pieces of at most ``part_spans`` spans, each with what it adds to the record."""
    numbered = group_ordinal(spans, GROUP, ("sequence_id", "start_time", "span_id"), "ordinal", heavy)
    calls = with_attrs(
        numbered.withColumn("part", F.floor(F.col("ordinal") / part_spans).cast("bigint")),
        messages="llm.request.messages",
        response="llm.response.content",
        model="llm.model",
    ).withColumn("query", last_content(F.col("messages")))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", *_SPAN_FIELDS)))
    parts = calls.groupBy(*GROUP, "part").agg(
        ordered.alias("spans"),
        F.min_by("query", F.when(F.length("query") > 0, F.col("ordinal"))).alias("query"),
        F.max_by("response", F.when(F.length("response") > 0, F.col("ordinal"))).alias("response"),
        F.max_by("model", "ordinal").alias("model"),
        F.max("reward").alias("reward"),
        F.min("start_time").alias("timestamp"),
        F.count("*").alias("n_spans"),
    )
    listed = F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in _SPAN_FIELDS]))
    return parts.withColumn("trajectory", F.to_json(listed, {"ignoreNullFields": "false"})).drop("spans")


def _heads_by_window(parts: DataFrame) -> DataFrame:
    """Record-wide values for ordinary groups: the rows of a group are already in one partition."""
    whole = Window.partitionBy(*GROUP).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return parts.withColumns(
        {
            "query": F.first("query", ignorenulls=True).over(whole),
            "response": F.last("response", ignorenulls=True).over(whole),
            "model": F.last("model").over(whole),
            "timestamp": F.min("timestamp").over(whole),
            "n_spans": F.sum("n_spans").over(whole),
        }
    )


def _heads_by_join(parts: DataFrame) -> DataFrame:
    """The same for heavy groups, of which there are at most as many as the heavy list is long."""
    heads = parts.groupBy(*GROUP).agg(
        F.min_by("query", F.when(F.col("query").isNotNull(), F.col("part"))).alias("query"),
        F.max_by("response", F.when(F.col("response").isNotNull(), F.col("part"))).alias("response"),
        F.max_by("model", "part").alias("model"),
        F.min("timestamp").alias("timestamp"),
        F.sum("n_spans").alias("n_spans"),
    )
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in GROUP]
    return parts.alias("r").join(F.broadcast(heads.alias("h")), same).select(
        *[F.col(f"r.{c}") for c in (*GROUP, "part", "trajectory", "reward")],
        *[F.col(f"h.{c}") for c in ("query", "response", "model", "timestamp", "n_spans")],
    )


def spans_to_rl(spans: DataFrame, rewards: DataFrame | None = None, part_spans: int = TRAJECTORY_PART) -> DataFrame:
    """One RL record per rollout and attempt, trajectory in sequence order, reward joined on.

    ``rewards`` has ``rollout_id`` and ``reward``. A trajectory of more than ``part_spans`` spans
    continues in rows with ``part`` 1, 2, ...: no row or task has to hold an unbounded one. The reward
    is joined to the spans, whose partitioning by rollout then also serves the trajectories, so that
    the long texts are shuffled once.
    """
    heavy = heavy_keys(spans, GROUP)
    if rewards is None:
        spans = spans.withColumn("reward", F.lit(None).cast("double"))
    else:
        per_rollout = rewards.groupBy("rollout_id").agg(F.max("reward").cast("double").alias("reward"))
        spans = join_unique(spans.drop("reward"), per_rollout, ["rollout_id"])
    normal, hot = split_heavy(spans, GROUP, heavy) if heavy else (spans, None)
    records = _heads_by_window(_trajectory_parts(normal, [], part_spans))
    if hot is not None:
        records = records.unionByName(_heads_by_join(_trajectory_parts(hot, heavy, part_spans)))
    return records.select(
        "rollout_id",
        "attempt_id",
        "part",
        "trajectory",
        "reward",
        "query",
        "response",
        "model",
        "timestamp",
        F.to_json(F.struct("n_spans")).alias("metadata"),
    )


# --- formats ----------------------------------------------------------------------------------


def _message(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("content"))


def trl_sft_conversational(sft: DataFrame) -> DataFrame:
    messages = F.array(_message("user", F.col("prompt")), _message("assistant", F.col("response")))
    return sft.select(messages.alias("messages"), "id", "model", "timestamp")


def trl_sft_instruction(sft: DataFrame) -> DataFrame:
    return sft.select(
        F.col("prompt").alias("instruction"), F.lit("").alias("input"), F.col("response").alias("output"), "id", "model"
    )


def trl_sft_text(sft: DataFrame) -> DataFrame:
    text = F.concat(F.lit("User: "), F.col("prompt"), F.lit("\nAssistant: "), F.col("response"))
    return sft.select(text.alias("text"), "id", "model")


def sft_with_reasoning(sft: DataFrame) -> DataFrame:
    """Conversational form with a non-empty thought chain as the leading system message."""
    pair = F.array(_message("user", F.col("prompt")), _message("assistant", F.col("response")))
    lead = F.array(_message("system", F.col("thought_chain")))
    messages = F.when(F.length("thought_chain") > 0, F.concat(lead, pair)).otherwise(pair)
    return sft.select(messages.alias("messages"), "id", "model", "timestamp")


def _has_any(df: DataFrame, **conditions: Column) -> dict[str, bool]:
    """Which conditions hold for some row: one aggregate, one row."""
    row = df.agg(*[F.coalesce(F.max(c), F.lit(False)).alias(n) for n, c in conditions.items()]).first()
    return row.asDict()


_TRAJECTORY = "ARRAY<STRUCT<attributes: STRING>>"
_WHOLE = ("rollout_id", "attempt_id")


def _part() -> Column:
    return F.coalesce("part", F.lit(0))


def _ends(rl: DataFrame) -> DataFrame:
    """One row per trajectory with the attributes of its first and last span, whatever its number of parts."""
    spans = F.from_json("trajectory", _TRAJECTORY)
    ends = rl.withColumn("first_span", F.get(spans, F.lit(0))["attributes"]).withColumn("last_span", F.try_element_at(spans, F.lit(-1))["attributes"])
    if "part" not in rl.columns:
        return ends
    # Every part has the query, response, model and reward of the whole trajectory.
    same = [F.min_by(c, _part()).alias(c) for c in ("query", "response", "model", "reward", "timestamp")]
    return ends.groupBy(*_WHOLE).agg(*same, F.min_by("first_span", _part()).alias("first_span"), F.max_by("last_span", _part()).alias("last_span"))


def whole_trajectories(rl: DataFrame) -> DataFrame:
    """One row per trajectory, its parts joined to one list. A trajectory that no row can hold stays in parts by not calling this."""
    if "part" not in rl.columns:
        return rl
    inner = F.expr("substring(coalesce(trajectory, '[]'), 2, length(coalesce(trajectory, '[]')) - 2)")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(_part().alias("part"), inner.alias("text")))), lambda p: p["text"])
    listed = F.concat(F.lit("["), F.array_join(F.filter(pieces, lambda p: F.length(p) > 0), ","), F.lit("]"))
    same = [F.min_by(c, _part()).alias(c) for c in ("query", "response", "model", "reward", "timestamp")]
    return rl.groupBy(*_WHOLE).agg(listed.alias("trajectory"), *same)


def trl_rl(rl: DataFrame) -> DataFrame:
    """Query/response pairs; an empty side falls back to the first or last span of the trajectory.

    The reward column is kept only if some record has one.
    """
    ends = _ends(rl)
    asked = F.coalesce(
        F.get_json_object("first_span", "$['llm.messages']"), F.get_json_object("first_span", "$['llm.request.messages']")
    )
    answered = F.get_json_object("last_span", "$['llm.response.content']")
    columns = [
        F.coalesce(_nonempty(F.col("query")), asked, F.lit("")).alias("query"),
        F.coalesce(_nonempty(F.col("response")), answered, F.lit("")).alias("response"),
        "rollout_id",
        "attempt_id",
        "model",
    ]
    if _has_any(rl, reward=F.col("reward").isNotNull())["reward"]:
        columns.append("reward")
    return ends.select(*columns)


def reward_pairs(records: DataFrame) -> DataFrame:
    return records.select("prompt", "chosen", "rejected")


def build_pairs(rl: DataFrame) -> DataFrame:
    """Best against worst response per prompt; prompts whose rewards do not differ give no pair."""
    rated = rl.where(F.col("reward").isNotNull() & (F.length("query") > 0) & (F.length("response") > 0))
    best = F.max_by("response", F.struct("reward", "rollout_id", "attempt_id"))
    worst = F.min_by("response", F.struct("reward", "rollout_id", "attempt_id"))
    return (
        rated.groupBy(F.col("query").alias("prompt"))
        .agg(best.alias("chosen"), worst.alias("rejected"), F.min("reward").alias("lo"), F.max("reward").alias("hi"))
        .where(F.col("hi") > F.col("lo"))
        .select("prompt", "chosen", "rejected")
    )


def hf_sft(sft: DataFrame) -> DataFrame:
    """Dataset columns; the thought and token columns exist only if some record has a value there."""
    columns = [
        "id",
        "prompt",
        "response",
        F.coalesce(_nonempty(F.col("model")), F.lit("unknown")).alias("model"),
        "timestamp",
    ]
    found = _has_any(sft, thoughts=F.length("thought_chain") > 0, tokens=F.col("prompt_tokens") != 0)
    if found["thoughts"]:
        columns.append(_filled("thought_chain").alias("thought_chain"))
    if found["tokens"]:
        columns += [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in _TOKENS]
    return sft.select(*columns)


def hf_rl(rl: DataFrame) -> DataFrame:
    """Dataset columns, one row per trajectory."""
    return whole_trajectories(rl).select(
        "rollout_id",
        "attempt_id",
        _filled("query").alias("query"),
        _filled("response").alias("response"),
        F.coalesce("reward", F.lit(0.0)).alias("reward"),
        F.coalesce(_nonempty(F.col("model")), F.lit("unknown")).alias("model"),
        "timestamp",
        _filled("trajectory", "[]").alias("trajectory"),
    )


# --- split ------------------------------------------------------------------------------------

_SLOTS = 65_536


def _hash_number(keys: Sequence[str]) -> Column:
    """A repeatable number below 2^32 from the first 8 hex digits of the md5 of the key."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _hash_slot(keys: Sequence[str], slots: int) -> Column:
    return _hash_number(keys) % slots


def train_test_split(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.1, exact: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Repeatable split by a hash of the key. A single row is not split.

    Without ``exact`` the test part is every key in the first ``test_size`` of 10,000 slots, the last of them in part: no
    shuffle, fraction approximate, copies of a key stay together. With ``exact`` it has exactly
    ``ceil(rows * test_size)`` rows: whole slots up to the boundary, and numbered rows of the one slot
    that the boundary cuts.
    """
    keys = list(keys)
    if len(df.select(*keys).take(2)) <= 1:
        return df, df.limit(0)
    if not exact:
        number = _hash_number(keys)
        # The slot, and the place in it as a fraction: numbers below 2^32 fill less than 429,497 places of a slot.
        in_test = number % 10_000 + F.floor(number / 10_000) / F.lit(429_497.0) < test_size * 10_000
        return df.where(~in_test), df.where(in_test)
    slot = _hash_slot(keys, _SLOTS)
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # At most 65,536 rows.
    counts = df.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    totals = counts.withColumns({"total": F.sum("n").over(upto), "rows": F.sum("n").over(Window.partitionBy())})
    boundary = totals.where(F.col("total") >= F.ceil(F.col("rows") * test_size)).orderBy("slot").first()
    wanted = math.ceil(boundary["rows"] * test_size)
    take = wanted - (boundary["total"] - boundary["n"])
    cut = global_ordinal(df.where(slot == boundary["slot"]), keys, "_place")
    test = df.where(slot < boundary["slot"]).unionByName(cut.where(F.col("_place") < take).drop("_place"))
    train = df.where(slot > boundary["slot"]).unionByName(cut.where(F.col("_place") >= take).drop("_place"))
    return train, test


# --- dispatch ---------------------------------------------------------------------------------

FORMATS: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {
    ("trl", "sft"): trl_sft_conversational,
    ("trl", "rl"): trl_rl,
    ("hf", "sft"): hf_sft,
    ("hf", "rl"): hf_rl,
}

SFT_FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "conversational": trl_sft_conversational,
    "instruction": trl_sft_instruction,
    "text": trl_sft_text,
}


def trl_sft(sft: DataFrame, sft_format: str = "conversational", include_thoughts: bool = False) -> DataFrame:
    if sft_format not in SFT_FORMATS:
        raise ValueError(f"Unknown SFT format: {sft_format}")
    if include_thoughts and sft_format == "conversational":
        return sft_with_reasoning(sft)
    return SFT_FORMATS[sft_format](sft)


def export(
    spark: SparkSession,
    source: str,
    target: str,
    format: str = "trl",
    type: str = "sft",
    sft_format: str = "conversational",
    include_thoughts: bool = False,
    split_train_test: bool = False,
    test_size: float = 0.1,
) -> None:
    """Read records, convert them and write the training set."""
    if (format, type) not in FORMATS:
        raise ValueError(f"no export of {type} records as {format}; there are {sorted(FORMATS)}")
    records = read_records(spark, source, type)
    if (format, type) == ("trl", "sft"):
        result = trl_sft(records, sft_format, include_thoughts)
    else:
        result = FORMATS[format, type](records)
    if split_train_test and (format, type) == ("hf", "sft"):
        export_splits(*train_test_split(result, ["id"], test_size), target)
    else:
        export_parquet(result, target)
