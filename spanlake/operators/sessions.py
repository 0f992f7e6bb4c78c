"""Sessions, windowed rates and span trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_dir
from .skew import join_unique


def session_spans(spans: DataFrame, session_id: str, session_col: str = "rollout_id") -> DataFrame:
    """All spans of one session in sequence order."""
    return spans.where(F.col(session_col) == session_id).orderBy("sequence_id", "start_time", "span_id")


def session_metrics(
    df: DataFrame, key: str, seconds: str, gap_seconds: int, tokens: Sequence[str] = ()
) -> DataFrame:
    """Sessions of each key: rows at most ``gap_seconds`` apart belong together.

    Rows are first aggregated into slices of that width. Rows of one slice are always in one session,
    so this is exact, runs map-side, and leaves (time range / gap) rows of even the busiest key for the
    window that joins slices into sessions. The session ends one gap after its last row.
    """
    at = F.col(seconds).cast("double")
    sums = [F.sum(c).alias(c) for c in tokens]
    slices = (
        df.groupBy(key, F.floor(at / gap_seconds).alias("slice"))
        .agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("turns"), *sums)
    )
    in_key = Window.partitionBy(key).orderBy("slice")
    # Spark's session_window also merges rows that are exactly one gap apart.
    starts = F.coalesce(F.col("first") - F.lag("last").over(in_key) > gap_seconds, F.lit(True))
    numbered = slices.withColumn("new", starts.cast("int")).withColumn(
        "session_no", F.sum("new").over(in_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return numbered.groupBy(key, "session_no").agg(
        F.min("first").alias("session_start"),
        F.max("last").alias("last_seen"),
        (F.max("last") + gap_seconds).alias("session_end"),
        F.sum("turns").cast("bigint").alias("turns"),
        *[F.sum(c).cast("bigint").alias(c) for c in tokens],
    ).drop("session_no")


def sessionize(df: DataFrame, key: str, timestamp: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions by ``session_window``; the form to use on streams, where state is kept per session."""
    window = F.session_window(timestamp, gap)
    return df.groupBy(key, window.alias("session")).agg(F.count("*").alias("turns")).select(
        key,
        F.col("session.start").alias("session_start"),
        F.col("session.end").alias("session_end"),
        "turns",
    )


def rollout_metrics(spans: DataFrame) -> DataFrame:
    """Start, end, turns and tokens of each rollout of a span table with token columns."""
    return spans.groupBy("rollout_id").agg(
        F.min("start_time").alias("start"),
        F.max("end_time").alias("end"),
        F.count("*").alias("turns"),
        F.sum("total_tokens").cast("bigint").alias("total_tokens"),
    )


def windowed_rates(df: DataFrame, timestamp: str, width: str, latency: str, failed: Column) -> DataFrame:
    """Requests, latency (average and approximate 95th percentile) and error rate per window."""
    return df.groupBy(F.window(timestamp, width).alias("w")).agg(
        F.count("*").alias("requests"),
        F.avg(latency).alias("avg_latency"),
        F.percentile_approx(latency, 0.95).alias("p95_latency"),
        (F.count_if(failed) / F.count("*")).alias("error_rate"),
    ).select(F.col("w.start").alias("window_start"), "requests", "avg_latency", "p95_latency", "error_rate")


#: Accuracy of the quantile sketches: ranks are off by less than 1 % with a probability of 99 %.
SKETCH_K = 400


def latency_sketches(df: DataFrame, timestamp: str, width: str, latency: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per window (and keys) the requests and a mergeable sketch of their latencies, a few KB whatever their number. Also for streams."""
    found = df.groupBy(F.window(timestamp, width).alias("w"), *keys).agg(
        F.count(latency).alias("requests"), F.kll_sketch_agg_double(F.col(latency).cast("double"), F.lit(SKETCH_K)).alias("sketch")
    )
    return found.select(F.col("w.start").alias("window_start"), *keys, "requests", "sketch")


def latency_percentiles(sketches: DataFrame, unit: str, ranks: Sequence[float] = (0.5, 0.95, 0.99), keys: Sequence[str] = ()) -> DataFrame:
    """Percentiles per ``unit`` (hour, day, month) from stored sketches of shorter windows; the latencies themselves are not read again."""
    whole = sketches.groupBy(F.date_trunc(unit, "window_start").alias("window_start"), *keys).agg(
        F.sum("requests").alias("requests"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    named = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(r))).alias(f"p{round(100 * r)}") for r in ranks]
    return whole.select("window_start", *keys, "requests", *named)


def with_date_hour(spans: DataFrame) -> DataFrame:
    """UTC ``date`` and ``hour`` partition columns from the start time."""
    second = F.floor("start_time")
    day = F.floor(second / 86400)
    return spans.withColumns(
        {
            "date": F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd"),
            "hour": F.floor((second - day * 86400) / 3600).cast("int"),
        }
    )


def span_children(spans: DataFrame) -> DataFrame:
    """Tree edges with depth: ``span_id, parent_id, root_id, depth`` (a root has depth 0).

    Pointer doubling: each round every open span jumps to the ancestor of its ancestor, so the rounds
    grow with the logarithm of the depth, and spans that reached their root leave the join. A parent
    that is not in the table makes its child a root. Spans on or below a cycle keep a null root and depth.
    """
    shared_dir(spans.sparkSession)
    ids = spans.groupBy("span_id").agg(F.max("parent_id").alias("parent_id"))
    known = ids.select(F.col("span_id").alias("parent_id"), F.lit(True).alias("known"))
    jump = (
        join_unique(ids, known, ["parent_id"])
        .select(
            "span_id",
            "parent_id",
            F.when(F.col("known"), F.col("parent_id")).alias("up"),
            F.when(F.col("known"), 1).otherwise(0).cast("bigint").alias("dist"),
            F.col("known").isNull().alias("done"),
        )
        .checkpoint()
    )
    rounds = max(1, jump.count()).bit_length() + 1
    for _ in range(rounds):
        active = jump.where(~F.col("done"))
        if active.isEmpty():
            break
        tops = jump.select(F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"))
        moved = join_unique(active, tops, ["up"]).select(
            "span_id",
            "parent_id",
            F.coalesce("up2", "up").alias("up"),
            (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"),
            F.col("up2").isNull().alias("done"),
        )
        jump = jump.where(F.col("done")).unionByName(moved).checkpoint()
    return jump.select(
        "span_id",
        "parent_id",
        F.when(F.col("done"), F.coalesce("up", "span_id")).alias("root_id"),
        F.when(F.col("done"), F.col("dist")).alias("depth"),
    )
