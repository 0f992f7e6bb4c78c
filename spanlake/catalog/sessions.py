"""Registered queries on sessions, windows and span trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import to_epoch, with_attrs
from ..operators import sessions as ops
from ..session import scratch_path
from . import fixtures as fx
from .registry import registry

QUERIES, ORACLE, query = registry()

# Islands of events of a user at most 30 minutes apart.
SESSIONS = """WITH stepped AS (SELECT user_id, ts, value,
      CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM stepped)"""


@query(
    "session_spans",
    f"WITH {fx.SPANS} SELECT span_id, sequence_id, start_time FROM spans WHERE rollout_id = 'ro-000000000009'",
)
def session_spans(spark, folder):
    found = ops.session_spans(fx.spans(spark, folder), "ro-000000000009")
    return found.select("span_id", "sequence_id", "start_time")


@query(
    "sessionize",
    f"""{SESSIONS} SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
    strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS turns
    FROM numbered GROUP BY user_id, n""",
)
def sessionize(spark, folder):
    events = fx.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = ops.sessionize(events, "user_id", "ts")
    text = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("session_start", "session_end")]
    return found.select("user_id", *text, "turns")


@query(
    "session_metrics",
    f"""{SESSIONS} SELECT user_id, epoch_us(min(ts)) / 1e6 AS session_start, epoch_us(max(ts)) / 1e6 AS last_seen,
    round(epoch_us(max(ts)) / 1e6 + 1800, 6) AS session_end, count(*) AS turns, sum(floor(value))::BIGINT AS tokens
    FROM numbered GROUP BY user_id, n""",
)
def session_metrics(spark, folder):
    events = fx.table(spark, folder, "events").select(
        "user_id", to_epoch(F.col("ts")).alias("at"), F.floor("value").alias("tokens")
    )
    found = ops.session_metrics(events, "user_id", "at", 1800, ["tokens"])
    return found.withColumn("session_end", F.round("session_end", 6))


@query(
    "rollout_metrics",
    f"""WITH {fx.SPANS} SELECT rollout_id, min(start_time) AS start, max(end_time) AS "end", count(*) AS turns,
    sum(total_tokens)::BIGINT AS total_tokens FROM spans GROUP BY rollout_id""",
)
def rollout_metrics(spark, folder):
    return ops.rollout_metrics(with_attrs(fx.spans(spark, folder), total_tokens="llm.usage.total_tokens"))


@query(
    "windowed_rates",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests,
    round(avg(value), 6) AS avg_latency, quantile_disc(value, 0.95) AS p95_latency,
    round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate FROM events GROUP BY 1""",
)
def windowed_rates(spark, folder):
    events = fx.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = ops.windowed_rates(events, "ts", "1 day", "value", F.col("event_type") == "error")
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "requests",
        F.round("avg_latency", 6).alias("avg_latency"),
        "p95_latency",
        F.round("error_rate", 6).alias("error_rate"),
    )


@query(
    "span_children",
    """SELECT 'e' || event_id::VARCHAR AS span_id,
    CASE WHEN event_id % 4 <> 0 THEN 'e' || (event_id - 1)::VARCHAR END AS parent_id,
    'e' || (event_id - event_id % 4)::VARCHAR AS root_id, event_id % 4 AS depth FROM events""",
)
def span_children(spark, folder):
    return ops.span_children(fx.event_spans(spark, folder))


@query(
    "latency_percentiles_rollup",
    """SELECT event_type, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, count(*) AS requests, true AS p50_close, true AS p95_close, true AS p99_close
    FROM events GROUP BY 1, 2""",
)
def latency_percentiles_rollup(spark, folder):
    """Hourly sketches, stored and merged to months: each percentile has a rank within 2 % of its own among the exact latencies."""
    path = scratch_path(spark, "sketches")
    events = fx.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ops.latency_sketches(events, "ts", "1 hour", "value", ["event_type"]).write.parquet(path)
    found = ops.latency_percentiles(spark.read.parquet(path), "month", keys=["event_type"])
    keyed = events.select("event_type", F.date_trunc("month", "ts").alias("window_start"), "value")
    ranked = keyed.join(found, ["event_type", "window_start"]).groupBy("event_type", "window_start", "requests")

    def close(name: str, rank: float):
        below, upto = (F.count_if(test) / F.count("*") for test in (F.col("value") < F.col(name), F.col("value") <= F.col(name)))
        return ((below <= rank + 0.02) & (upto >= rank - 0.02)).alias(f"{name}_close")

    checked = ranked.agg(*[close(f"p{round(100 * r)}", r) for r in (0.5, 0.95, 0.99)])
    return checked.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("month"), "requests", "p50_close", "p95_close", "p99_close")
