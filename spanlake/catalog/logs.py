"""Registered queries on the access log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import iso_duration_ms
from ..operators import access_log as ops
from . import fixtures as fx
from .registry import registry

QUERIES, ORACLE, query = registry()

_IS_ERROR = "(type = 'error' OR length(error) > 0)"
_DURATION = "CASE WHEN type = 'response' THEN duration_ms END"
_DURATIONS = (
    f"round(coalesce(avg({_DURATION}), 0), 6) AS avg_ms, min({_DURATION}) AS min_ms, max({_DURATION}) AS max_ms"
)


def _rounded(df):
    return df.withColumn("avg_ms", F.round("avg_ms", 6))


@query("log_count_by_type", f"WITH {fx.LOG} SELECT type, count(*) AS count FROM log GROUP BY type")
def count_by_type(spark, folder):
    return ops.count_by_type(fx.log(spark, folder))


@query(
    "log_count_by_status",
    f"WITH {fx.LOG} SELECT status_code, count(*) AS count FROM log WHERE type = 'response' GROUP BY status_code",
)
def count_by_status(spark, folder):
    counted = ops.count_by_status(fx.log(spark, folder))
    return counted.withColumn("status_code", F.col("status_code").cast("bigint"))


@query(
    "log_top_paths",
    f"""WITH {fx.LOG} SELECT coalesce(path, 'unknown') AS path, count(*) AS count FROM log WHERE type = 'request'
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top_paths(spark, folder):
    return ops.top_paths(fx.log(spark, folder))


@query("log_count_errors", f"WITH {fx.LOG} SELECT count(*) AS errors FROM log WHERE {_IS_ERROR}")
def count_errors(spark, folder):
    return ops.count_errors(fx.log(spark, folder))


@query(
    "log_top_error_paths",
    f"""WITH {fx.LOG} SELECT coalesce(path, 'unknown') AS path, count(*) AS count FROM log WHERE {_IS_ERROR}
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top_error_paths(spark, folder):
    return ops.top_error_paths(fx.log(spark, folder))


@query(
    "log_top_error_request_paths",
    f"""WITH {fx.LOG}, asked AS (SELECT request_id, path FROM log WHERE type = 'request')
    SELECT coalesce(l.path, a.path, 'unknown') AS path, count(*) AS count
    FROM log l LEFT JOIN asked a ON l.type = 'response' AND a.request_id = l.request_id
    WHERE l.type = 'error' OR length(l.error) > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top_error_request_paths(spark, folder):
    log = fx.log(spark, folder)
    requests, responses = (ops.filter_log(log, type=t) for t in ("request", "response"))
    linked = ops.correlate_log(requests, responses).drop("request_timestamp")
    whole = ops.filter_log(log, type="error").unionByName(linked)
    return ops.top_error_paths(whole, use_request_path=True)


@query("log_duration_stats", f"WITH {fx.LOG} SELECT {_DURATIONS} FROM log")
def duration_stats(spark, folder):
    return _rounded(ops.duration_stats(fx.log(spark, folder)))


@query("log_time_range", f'WITH {fx.LOG} SELECT min(timestamp) AS start, max(timestamp) AS "end" FROM log')
def time_range(spark, folder):
    return ops.time_range(fx.log(spark, folder))


@query(
    "log_summary",
    f"""WITH {fx.LOG} SELECT count(*) AS entries, min(timestamp) AS start, max(timestamp) AS "end",
    count(*) FILTER (WHERE type = 'request') AS requests, count(*) FILTER (WHERE type = 'response') AS responses,
    count(*) FILTER (WHERE {_IS_ERROR}) AS errors, {_DURATIONS} FROM log""",
)
def summary(spark, folder):
    return _rounded(ops.log_summary(fx.log(spark, folder)))


@query(
    "log_filter",
    f"""WITH {fx.LOG} SELECT request_id, timestamp, status_code, error, duration_ms FROM log
    WHERE type = 'response' AND status_code = 500""",
)
def filtered(spark, folder):
    found = ops.filter_log(fx.log(spark, folder), type="response", status=500)
    return found.select(
        "request_id", "timestamp", F.col("status_code").cast("bigint").alias("status_code"), "error", "duration_ms"
    )


@query(
    "log_details",
    f"""WITH {fx.LOG} SELECT upper(type) AS entry, timestamp, coalesce(request_id, 'N/A') AS request_id, method, path,
    status_code::VARCHAR AS status,
    CASE WHEN type = 'response' THEN CASE WHEN duration_ms IS NULL THEN 'no' ELSE 'yes' END END AS timed, error,
    CASE WHEN length(body) > 200 THEN substr(body, 1, 200) || '...' ELSE body END AS body FROM log""",
)
def details(spark, folder):
    timed = F.when(F.col("duration").isNotNull(), F.when(F.col("duration") == "N/A ms", "no").otherwise("yes"))
    return ops.log_detail_view(fx.log(spark, folder)).withColumn("timed", timed).drop("duration")


@query(
    "log_most_common_users",
    "SELECT user_id, count(*) AS count FROM events GROUP BY user_id ORDER BY count DESC, user_id LIMIT 15",
)
def most_common_users(spark, folder):
    return ops.most_common(fx.table(spark, folder, "events").groupBy("user_id").count(), "user_id", 15)


_LINKED = f"""WITH {fx.LOG}, asked AS (SELECT * FROM log WHERE type = 'request')
    SELECT s.request_id, s.timestamp, a.method AS request_method, a.path AS request_path,
    a.timestamp AS request_timestamp, round(date_diff('microsecond', a.ts, s.ts) / 1000.0::DOUBLE, 3) AS duration_ms
    FROM log s LEFT JOIN asked a ON a.request_id = s.request_id WHERE s.type = 'response'"""


def linked_columns(df):
    return df.select(
        "request_id",
        "timestamp",
        "request_method",
        "request_path",
        "request_timestamp",
        F.round("duration_ms", 3).alias("duration_ms"),
    )


@query("log_correlate", _LINKED)
def correlate(spark, folder):
    log = fx.log(spark, folder)
    return linked_columns(ops.correlate_log(ops.filter_log(log, "request"), ops.filter_log(log, "response")))


OPEN = f"""WITH {fx.LOG} SELECT request_id, timestamp, path FROM log a WHERE type = 'request' AND NOT EXISTS (
    SELECT 1 FROM log s WHERE s.type = 'response' AND s.request_id = a.request_id)"""


@query("log_open_requests", OPEN)
def open_requests(spark, folder):
    log = fx.log(spark, folder)
    found = ops.open_requests(ops.filter_log(log, "request"), ops.filter_log(log, "response"))
    return found.select("request_id", "timestamp", "path")


@query(
    "iso_duration",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL
    ELSE round(date_diff('microsecond', date_trunc('day', ts), ts) / 1000.0::DOUBLE, 3) END AS since_midnight FROM events""",
)
def iso_durations(spark, folder):
    start = F.date_format("ts", "yyyy-MM-dd'T'00:00:00")
    end = F.when(F.col("event_id") % 5 == 0, "unreadable").otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
    return fx.table(spark, folder, "events").select(
        "event_id", F.round(iso_duration_ms(start, end), 3).alias("since_midnight")
    )


LINKED = _LINKED

# Ids that come back every 400 entries.
_REUSED = f"""WITH {fx.LOG}, reused AS (SELECT * REPLACE ('r' || (substr(request_id, 2)::BIGINT % 400)::VARCHAR AS request_id) FROM log
    WHERE type IN ('request', 'response')), placed AS (SELECT *, lag(type) OVER w AS b_type, lag(method) OVER w AS b_method, lag(path) OVER w AS b_path,
    lag(timestamp) OVER w AS b_timestamp, lag(ts) OVER w AS b_ts, lead(type) OVER w AS a_type FROM reused
    WINDOW w AS (PARTITION BY request_id ORDER BY timestamp, type))"""


def _reused(spark, folder):
    number = F.substring("request_id", 2, 20).cast("bigint") % 400
    log = fx.log(spark, folder).withColumn("request_id", F.concat(F.lit("r"), number.cast("string")))
    return ops.filter_log(log, "request"), ops.filter_log(log, "response")


LINKED_REUSED = f"""{_REUSED} SELECT request_id, timestamp, CASE WHEN b_type = 'request' THEN b_method END AS request_method,
    CASE WHEN b_type = 'request' THEN b_path END AS request_path, CASE WHEN b_type = 'request' THEN b_timestamp END AS request_timestamp,
    CASE WHEN b_type = 'request' THEN round(date_diff('microsecond', b_ts, ts) / 1000.0::DOUBLE, 3) END AS duration_ms
    FROM placed WHERE type = 'response'"""
OPEN_REUSED = f"{_REUSED} SELECT request_id, timestamp, path FROM placed WHERE type = 'request' AND a_type IS NULL"


@query("log_correlate_reused", LINKED_REUSED)
def correlate_reused(spark, folder):
    """A response belongs to the last request with its id since the response before it."""
    return linked_columns(ops.correlate_log(*_reused(spark, folder)))


@query("log_open_requests_reused", OPEN_REUSED)
def open_requests_reused(spark, folder):
    return ops.open_requests(*_reused(spark, folder)).select("request_id", "timestamp", "path")
