"""Operators on the HTTP access log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import iso_duration_ms, truncate_text
from .ordinals import event_before


def is_error() -> Column:
    return (F.col("type") == "error") | (F.length("error") > 0)


def _path(use_request_path: bool = False) -> Column:
    """Path of an entry. Responses carry theirs as ``request_path``, which parity leaves out."""
    found = [F.col("path"), F.col("request_path")] if use_request_path else [F.col("path")]
    return F.coalesce(*found, F.lit("unknown"))


def most_common(counts: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k largest counts; ties in key order."""
    return counts.orderBy(F.col("count").desc(), F.col(key).asc_nulls_first()).limit(k)


def count_by_type(log: DataFrame) -> DataFrame:
    return log.groupBy("type").count()


def count_by_status(log: DataFrame) -> DataFrame:
    return log.where(F.col("type") == "response").groupBy("status_code").count()


def count_by_path(log: DataFrame) -> DataFrame:
    return log.where(F.col("type") == "request").groupBy(_path().alias("path")).count()


def count_by_error_path(log: DataFrame, use_request_path: bool = False) -> DataFrame:
    return log.where(is_error()).groupBy(_path(use_request_path).alias("path")).count()


def top_paths(log: DataFrame, k: int = 10) -> DataFrame:
    return most_common(count_by_path(log), "path", k)


def top_error_paths(log: DataFrame, k: int = 10, use_request_path: bool = False) -> DataFrame:
    return most_common(count_by_error_path(log, use_request_path), "path", k)


def count_errors(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if(is_error()).alias("errors"))


def _durations() -> Column:
    return F.when(F.col("type") == "response", F.col("duration_ms"))


def _duration_aggregates() -> list[Column]:
    return [
        F.coalesce(F.avg(_durations()), F.lit(0.0)).alias("avg_ms"),
        F.min(_durations()).alias("min_ms"),
        F.max(_durations()).alias("max_ms"),
    ]


def duration_stats(log: DataFrame) -> DataFrame:
    """Average, least and largest response duration; the average of none is 0."""
    return log.agg(*_duration_aggregates())


def _range_aggregates() -> list[Column]:
    stamp = F.when(F.length("timestamp") > 0, F.col("timestamp"))
    return [
        F.coalesce(F.min(stamp), F.lit("N/A")).alias("start"),
        F.coalesce(F.max(stamp), F.lit("N/A")).alias("end"),
    ]


def time_range(log: DataFrame) -> DataFrame:
    return log.agg(*_range_aggregates())


def log_summary(log: DataFrame) -> DataFrame:
    """One row over the whole log from a single aggregate."""
    return log.agg(
        F.count("*").alias("entries"),
        *_range_aggregates(),
        F.count_if(F.col("type") == "request").alias("requests"),
        F.count_if(F.col("type") == "response").alias("responses"),
        F.count_if(is_error()).alias("errors"),
        *_duration_aggregates(),
    )


def filter_log(log: DataFrame, type: str | None = None, status: int | None = None) -> DataFrame:
    if type is not None:
        log = log.where(F.col("type") == type)
    if status is not None:
        log = log.where(F.col("status_code") == status)
    return log


def log_detail_view(log: DataFrame) -> DataFrame:
    """Detail columns of each entry; those that do not belong to its type are null."""
    kind = F.col("type")
    request, response, error = (kind == k for k in ("request", "response", "error"))

    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("N/A"))

    body = F.when(F.length("body") > 0, truncate_text(F.col("body"), 200, "..."))
    return log.select(
        F.upper(F.coalesce(kind, F.lit("unknown"))).alias("entry"),
        shown(F.col("timestamp")).alias("timestamp"),
        shown(F.col("request_id")).alias("request_id"),
        F.when(request | error, shown(F.col("method"))).alias("method"),
        F.when(request | error, shown(F.col("path"))).alias("path"),
        F.when(response, shown(F.col("status_code"))).alias("status"),
        F.when(response, F.concat(shown(F.col("duration_ms")), F.lit(" ms"))).alias("duration"),
        F.when(response, F.when(F.length("error") > 0, F.col("error")))
        .when(error, shown(F.col("error")))
        .alias("error"),
        F.when(request | response, body).alias("body"),
    )


#: Seconds of a time slice; events look for their neighbour in their own slice first.
_SLICE_SECONDS = 3600


def _events(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Ids, times and kinds of both sides; a request sorts before a response of the same time."""
    told = F.struct("timestamp", "method", "path")
    asked = requests.select("request_id", "timestamp", F.lit(0).alias("kind"), told.alias("request"))
    answered = responses.select("request_id", "timestamp", F.lit(1).alias("kind"), F.lit(None).cast(asked.schema["request"].dataType).alias("request"))
    return asked.unionByName(answered).where(F.col("request_id").isNotNull())


def _slice() -> Column:
    return F.floor(F.unix_timestamp(F.to_timestamp("timestamp")) / _SLICE_SECONDS)


def request_contexts(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """The request of each response: the last one with its id since the response before it.

    One row per response id and time; a request is used up by the first response after it.
    """
    events = _events(requests, responses).dropDuplicates(["request_id", "timestamp", "kind"])
    order = ["timestamp", "kind"]
    before = F.struct("kind", "request")
    placed = event_before(events, ["request_id"], _slice(), order, before, "before").where("kind = 1 AND before.kind = 0")
    return placed.select(
        "request_id",
        "timestamp",
        F.col("before.request.method").alias("request_method"),
        F.col("before.request.path").alias("request_path"),
        F.col("before.request.timestamp").alias("request_timestamp"),
    )


def correlate_log(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Every response with method, path and start of its request; null when there is none."""
    derived = ("request_method", "request_path", "request_timestamp", "duration_ms")
    bare = responses.drop(*derived)
    # Rows without an id meet nobody, so they stay out of the join.
    named = bare.where(F.col("request_id").isNotNull())
    named = named.join(request_contexts(requests, responses), ["request_id", "timestamp"], "left").select(*bare.columns, *derived[:3])
    joined = named.unionByName(bare.where(F.col("request_id").isNull()), allowMissingColumns=True)
    elapsed = iso_duration_ms(F.col("request_timestamp"), F.col("timestamp"))
    return joined.withColumn("duration_ms", elapsed)


def open_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests that wait: nothing with their id follows. A request that another one with its id replaced waits no more."""
    events = _events(requests, responses).dropDuplicates(["request_id", "timestamp", "kind"])
    after = event_before(events, ["request_id"], _slice(), ["timestamp", "kind"], F.col("kind"), "after", after=True)
    done = after.where("kind = 0 AND after IS NOT NULL").select("request_id", "timestamp")
    named = requests.where(F.col("request_id").isNotNull()).join(done, ["request_id", "timestamp"], "left_anti")
    return named.select(*requests.columns).unionByName(requests.where(F.col("request_id").isNull()))
