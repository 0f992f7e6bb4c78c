"""Conversation turns: history, rebuilt conversations, and the calls they stand for.

The rows of a conversation are numbered from 0 in turn order, and every ``part_turns`` numbers are a
part: one rule, whatever the size and however the turns are numbered. All per-conversation work is
done per part; what a later part needs from earlier ones is carried by a table with one row per part.
Histories and message lists are complete in every part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordinals import slice_ordinal

PART_TURNS = 1024
#: Turn numbers that share a slice while rows are numbered.
_SLICE = 256
_KEYS = ["conv_id", "part"]


def with_part(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Add ``place``, the order of the rows of a conversation, and the ``part`` cut from it."""

    piece = F.floor(F.col("turn") / _SLICE)
    placed = slice_ordinal(turns, ["conv_id"], piece, ["turn", "role", "text"], "place")
    return placed.withColumn("part", F.floor(F.col("place") / part_turns).cast("bigint"))


def _co_located(turns: DataFrame, part_turns: int) -> DataFrame:
    """Turns with their part, shuffled on it. Shuffling here, before the window inputs are built, moves
    every text once; the windows then need no shuffle of their own."""
    return with_part(turns, part_turns).repartition(*_KEYS)


def _earlier(parts: DataFrame, item: Column, name: str) -> DataFrame:
    """Per part after the first: the items of all rows of the earlier parts, in order.

    The list of a part is sent to each later part, so that these are built by as many tasks as there are parts, however long one conversation is.
    """
    placed = F.when(item.isNotNull(), F.struct("place", item.alias("item")))
    listed = parts.groupBy(*_KEYS).agg(F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["item"]).alias("items"))
    last = parts.groupBy("conv_id").agg(F.max("part").alias("last"))
    sent = listed.join(last, "conv_id").where("part < last")
    sent = sent.select("conv_id", F.explode(F.sequence(F.col("part") + 1, F.col("last"))).alias("to"), F.struct("part", "items").alias("sent"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list("sent")), lambda x: x["items"]))
    return sent.groupBy("conv_id", F.col("to").alias("part")).agg(whole.alias(name))


def _long(parts: DataFrame) -> DataFrame:
    """The rows of conversations that have more than one part."""
    return parts.join(parts.where(F.col("part") > 0).select("conv_id").distinct(), "conv_id", "left_semi")


def with_history(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Add the messages before each turn: ``history`` (turn, role, text), system turns included."""
    before = Window.partitionBy(*_KEYS).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    message = F.struct("turn", "role", "text")
    parts = _co_located(turns, part_turns)
    own = parts.withColumn("history", F.collect_list(message).over(before))
    whole = own.join(_earlier(_long(with_part(turns, part_turns)), message, "_earlier"), _KEYS, "left")
    history = F.when(F.col("_earlier").isNull(), F.col("history")).otherwise(F.concat("_earlier", "history"))
    return whole.withColumn("history", history).select(*turns.columns, "history")


def rebuild_conversation(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation and part with its turns in order."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "turn", "role", "text")))
    listed = F.transform("turns", lambda t: F.struct(*[t[c].alias(c) for c in ("turn", "role", "text")]))
    return (
        with_part(turns, part_turns)
        .groupBy(*_KEYS)
        .agg(ordered.alias("turns"), F.count("*").alias("n_turns"))
        .withColumn("turns", listed)
    )


def multi_turn_sft(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Conversations as ``messages`` (role, content), complete up to the end of the part; ``n_turns`` are the part's own.

    So each part is an example that begins with the conversation, and the last one is all of it.
    """
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    own = rebuild_conversation(turns, part_turns).select(*_KEYS, messages.alias("messages"), "n_turns")
    before = _earlier(_long(with_part(turns, part_turns)), F.struct("role", F.col("text").alias("content")), "_earlier")
    whole = own.join(before, _KEYS, "left")
    carried = F.when(F.col("_earlier").isNull(), F.col("messages")).otherwise(F.concat("_earlier", "messages"))
    return whole.select(*_KEYS, carried.alias("messages"), "n_turns")


def _is(role: str) -> Column:
    return F.col("role") == role


def _carried(parts: DataFrame) -> DataFrame:
    """Per part after the first: totals, last user text and messages of the earlier parts."""
    plain = F.when(~_is("system"), F.struct(F.col("role"), F.col("text").alias("content")))
    totals = (
        parts.groupBy(*_KEYS)
        .agg(
            F.count_if(_is("assistant")).alias("n"),
            F.sum(F.when(~_is("system"), F.length("text"))).alias("chars"),
            F.max_by("text", F.when(_is("user"), F.col("place"))).alias("user"),
            F.min_by(F.struct("role", "text"), "place").alias("first"),
        )
    )
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *_KEYS,
        F.sum("n").over(earlier).alias("c_n"),
        F.sum("chars").over(earlier).alias("c_chars"),
        F.last("user", ignorenulls=True).over(earlier).alias("c_user"),
        F.first("first").over(earlier).alias("c_first"),
    ).where(F.col("part") > 0)
    return carried.join(_earlier(parts, plain, "c_messages"), _KEYS)


def calls_from_turns(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per assistant turn, with what its call must have looked like.

    ``messages`` are all earlier non-system turns. Characters stand in for tokens.
    """
    before = Window.partitionBy(*_KEYS).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = ~_is("system")
    message = F.struct(F.col("role"), F.col("text").alias("content"))
    parts = with_part(turns.select("conv_id", "turn", "role", "text"), part_turns)
    calls = parts.repartition(*_KEYS).select(
        *_KEYS,
        "turn",
        "role",
        "text",
        F.count_if(_is("assistant")).over(upto).alias("n"),
        F.sum(F.when(plain, F.length("text"))).over(before).alias("chars"),
        F.last(F.when(_is("user"), F.col("text")), ignorenulls=True).over(before).alias("user"),
        F.first(F.struct("role", "text")).over(upto).alias("first"),
        F.collect_list(F.when(plain, message)).over(before).alias("messages"),
    ).where(_is("assistant"))
    calls = calls.join(_carried(_long(parts)), _KEYS, "left")
    messages = F.when(F.col("c_messages").isNull(), F.col("messages")).otherwise(F.concat("c_messages", "messages"))
    first = F.coalesce("c_first", "first")
    prompt = F.coalesce("chars", F.lit(0)) + F.coalesce("c_chars", F.lit(0))
    done = F.length("text")
    start = F.lit(1704067200.0) + F.col("conv_id") * 600 + F.col("turn") * 5
    return calls.select(
        "conv_id",
        "turn",
        F.concat(F.lit("ro-"), F.lpad(F.col("conv_id").cast("string"), 12, "0")).alias("rollout_id"),
        F.concat(F.lit("at-"), F.lpad(F.col("conv_id").cast("string"), 8, "0")).alias("attempt_id"),
        (F.col("n") + F.coalesce("c_n", F.lit(0)) - 1).cast("bigint").alias("sequence_id"),
        F.concat(F.lit("model_"), (F.col("conv_id") % 3).cast("string")).alias("model"),
        F.when(first["role"] == "system", first["text"]).alias("system"),
        messages.alias("messages"),
        F.coalesce("user", "c_user").alias("last_user"),
        F.col("text").alias("response"),
        start.alias("start_time"),
        (start + (done % 4000) / 1000.0).alias("end_time"),
        prompt.cast("bigint").alias("prompt_tokens"),
        done.cast("bigint").alias("completion_tokens"),
        (prompt + done).cast("bigint").alias("total_tokens"),
    )
