"""Registered queries on lakes: writers, readers, files, batches. Each writes tables derived from the
given ones below the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks, sources
from ..functions import variant_attr
from ..operators import batches, spans as spans_ops, store
from ..operators.sessions import with_date_hour
from ..session import scratch_path
from . import fixtures as fx
from .calls import CAPTURED, captured_columns
from .registry import registry
from .spans import TOKENS

QUERIES, ORACLE, query = registry()

_SIZE, _KEEP = 700, 3000


def _lake(spark, folder, minutes=720):
    path = scratch_path(spark, "lake")
    sinks.write_spans(fx.event_spans(spark, folder), path, minutes)
    return path


_BY_SHARD = f"""WITH {fx.EVENT_SPANS} SELECT {fx.shard_sql('start_time', 720)} AS shard, count(*) AS spans,
    min(start_time) AS first_start, max(span_id) AS last_id FROM event_spans GROUP BY 1"""


@query("lake_round_trip", _BY_SHARD)
def lake_round_trip(spark, folder):
    spans = sources.read_spans(spark, _lake(spark, folder))
    return spans.groupBy("shard").agg(
        F.count("*").alias("spans"), F.min("start_time").alias("first_start"), F.max("span_id").alias("last_id")
    )


@query(
    "lake_one_shard",
    f"""WITH {fx.EVENT_SPANS} SELECT name, count(*) AS spans FROM event_spans
    WHERE {fx.shard_sql('start_time', 720)} = '20240115_120000' GROUP BY name""",
)
def lake_one_shard(spark, folder):
    spans = sources.read_spans(spark, _lake(spark, folder))
    return spans.where(F.col("shard") == "20240115_120000").groupBy("name").agg(F.count("*").alias("spans"))


@query("lake_token_totals", f"WITH {fx.RAW} SELECT model, {TOKENS} FROM raw WHERE NOT failed GROUP BY model")
def lake_token_totals(spark, folder):
    """Token totals from the promoted columns: the attribute text is not read."""
    spans = sources.read_spans(spark, fx.captured_path(spark, folder), promoted=True)
    return spans_ops.token_totals(spans.where(F.col("status") == "OK"), ["model"])


@query(
    "lake_latest_calls",
    f"WITH {fx.RAW} SELECT captured_id AS span_id, model, start_time FROM raw ORDER BY start_time DESC, captured_id LIMIT 12",
)
def lake_latest_calls(spark, folder):
    spans = sources.read_spans(spark, fx.captured_path(spark, folder), promoted=True)
    return spans_ops.latest(spans, 12).select("span_id", "model", "start_time")


@query(
    "lake_rollout_lookup",
    f"""WITH {fx.RAW} SELECT captured_id AS span_id, sequence_id, start_time FROM raw WHERE rollout_id = 'ro-000000000011'""",
)
def lake_rollout_lookup(spark, folder):
    spans = sources.read_spans(spark, fx.captured_path(spark, folder))
    return spans_ops.query_spans(spans, "ro-000000000011").select("span_id", "sequence_id", "start_time")


def _variant_lake(spark, folder):
    path = scratch_path(spark, "variant")
    sinks.write_spans(fx.captured(spark, folder), path, 720, variant=True)
    return sources.read_spans(spark, path, variant=True)


@query(
    "attr_variant_filter",
    f"""WITH {fx.RAW} SELECT captured_id AS span_id, model, 0.5::DOUBLE AS temperature, CASE WHEN conv_id % 2 = 0 THEN 256::BIGINT END AS max_tokens
    FROM captured WHERE NOT failed AND turn % 2 = 1""",
)
def attr_variant_filter(spark, folder):
    """A filter on an attribute that is no column of its own: read from the shredded VARIANT, no text is parsed."""
    spans = _variant_lake(spark, folder).where("status = 'OK'")
    wanted = {"temperature": ("llm.request.temperature", "double"), "max_tokens": ("llm.request.max_tokens", "bigint"), "model": ("llm.model", "string")}
    read = spans.select("span_id", *[variant_attr(F.col("attrs"), key, kind).alias(name) for name, (key, kind) in wanted.items()])
    return read.where("temperature = 0.5")


@query("attr_variant_totals", f"WITH {fx.RAW} SELECT model, {TOKENS} FROM raw WHERE NOT failed GROUP BY model")
def attr_variant_totals(spark, folder):
    """Token totals over the VARIANT: the operator takes its keys from there."""
    return spans_ops.token_totals(_variant_lake(spark, folder).where("status = 'OK'"), ["model"])


@query(
    "lake_span_lookup",
    f"""WITH {fx.RAW} SELECT captured_id AS span_id, model, start_time FROM raw WHERE captured_id IN (SELECT captured_id FROM raw ORDER BY conv_id, turn LIMIT 3)""",
)
def lake_span_lookup(spark, folder):
    """Spans by their ids, whose order says nothing about files; bloom filters leave out row groups."""
    spans = sources.read_spans(spark, fx.captured_path(spark, folder), promoted=True)
    first = fx.calls(spark, folder).orderBy("conv_id", "turn").limit(3)
    ids = [r[0] for r in first.select(F.substring(F.sha2(F.concat_ws("-", F.lit("call"), "conv_id", "turn"), 256), 33, 16)).collect()]
    return spans.where(F.col("span_id").isin(ids)).select("span_id", "model", "start_time")


@query(
    "lake_by_hour",
    f"""WITH {fx.SPANS}, timed AS (SELECT make_timestamp((start_time * 1000000)::BIGINT) AS ts FROM spans)
    SELECT strftime(ts, '%Y-%m-%d') AS date, hour(ts)::BIGINT AS hour, count(*) AS spans FROM timed GROUP BY 1, 2""",
)
def lake_by_hour(spark, folder):
    path = scratch_path(spark, "hours")
    sinks.write_spans_by_hour(fx.spans(spark, folder), path)
    spans = sources.read_spans(spark, path)
    return spans.groupBy(F.col("date").cast("string").alias("date"), F.col("hour").cast("bigint").alias("hour")).agg(
        F.count("*").alias("spans")
    )


@query(
    "date_hour",
    "SELECT 'e' || event_id::VARCHAR AS span_id, strftime(ts, '%Y-%m-%d') AS date, hour(ts)::BIGINT AS hour FROM events",
)
def date_hour(spark, folder):
    dated = with_date_hour(fx.event_spans(spark, folder))
    return dated.select("span_id", "date", F.col("hour").cast("bigint").alias("hour"))


@query("merge_spans", _BY_SHARD)
def merge_spans(spark, folder):
    """The compacted lake still has its shards."""
    target = scratch_path(spark, "merged")
    sinks.merge_spans(sources.read_spans(spark, _lake(spark, folder)), target)
    return sources.read_spans(spark, target).groupBy("shard").agg(
        F.count("*").alias("spans"), F.min("start_time").alias("first_start"), F.max("span_id").alias("last_id")
    )


def _totals(spark, path):
    spans = sources.read_spans(spark, path, promoted=True)
    return spans_ops.token_totals(spans.where(F.col("status") == "OK"), ["model"])


_TOTALS = f"WITH {fx.RAW} SELECT model, {TOKENS} FROM raw WHERE NOT failed GROUP BY model"


@query("merged_token_totals", _TOTALS)
def merged_token_totals(spark, folder):
    target = scratch_path(spark, "merged")
    sinks.merge_spans(sources.read_spans(spark, fx.captured_path(spark, folder)), target)
    return _totals(spark, target)


@query("hour_token_totals", _TOTALS)
def hour_token_totals(spark, folder):
    target = scratch_path(spark, "hours")
    sinks.write_spans_by_hour(fx.captured(spark, folder), target)
    return _totals(spark, target)


@query("batch_token_totals", _TOTALS)
def batch_token_totals(spark, folder):
    target = scratch_path(spark, "batches")
    spans = sources.read_spans(spark, fx.captured_path(spark, folder)).drop("shard")
    sinks.write_batches(batches.assign_batches(spans, _SIZE), target)
    return _totals(spark, target)


@query("imported_token_totals", _TOTALS)
def imported_token_totals(spark, folder):
    target = scratch_path(spark, "imported")
    sources.import_foreign(spark, fx.captured_path(spark, folder), target)
    return _totals(spark, target)


@query("file_stats", "SELECT 'ok' AS state, count(*) AS rows, true AS has_size FROM events")
def file_stats(spark, folder):
    stats = store.file_stats(spark, _lake(spark, folder))
    return stats.groupBy("state").agg(
        F.sum("rows").cast("bigint").alias("rows"), (F.min("bytes") > 0).alias("has_size")
    )


@query("file_stats_per_file")
def file_stats_per_file(spark, folder):
    return store.file_stats(spark, _lake(spark, folder))


@query(
    "file_stats_by_shard",
    f"""WITH {fx.EVENT_SPANS} SELECT {fx.shard_sql('start_time', 720)} AS shard, count(*)::BIGINT AS rows, true AS all_read, true AS has_size
    FROM event_spans GROUP BY 1""",
)
def file_stats_by_shard(spark, folder):
    """Rows per file, put together by the shard folder that a file lies in."""
    stats = store.file_stats(spark, _lake(spark, folder)).withColumn("shard", F.regexp_extract("path", "/shard=([^/]+)/", 1))
    return stats.groupBy("shard").agg(
        F.sum("rows").cast("bigint").alias("rows"), F.bool_and(F.col("state") == "ok").alias("all_read"), (F.min("bytes") > 0).alias("has_size")
    )


@query("dataset_stats", "SELECT count(*) AS rows, true AS has_files, true AS has_size FROM events")
def dataset_stats(spark, folder):
    stats = store.dataset_stats(spark, _lake(spark, folder))
    return stats.select(
        F.col("rows").cast("bigint").alias("rows"), (F.col("files") > 0).alias("has_files"), (F.col("kilobytes") > 0).alias("has_size")
    )


@query(
    "store_stats",
    f"""WITH {fx.EVENT_SPANS} SELECT count(*) AS spans, max({fx.shard_sql('start_time', 720)}) AS current_shard, true AS has_files FROM event_spans""",
)
def store_stats(spark, folder):
    stats = store.store_stats(sources.read_spans(spark, _lake(spark, folder)))
    return stats.withColumn("has_files", F.col("files") > 0).drop("files")


@query(
    "file_samples",
    """SELECT 'event_id, user_id, props' AS columns, arg_min(event_id, event_id)::VARCHAR AS event_id,
    arg_min(user_id, event_id)::VARCHAR AS user_id, arg_min(props, event_id) AS props FROM events""",
)
def file_samples(spark, folder):
    events = fx.table(spark, folder, "events").select("event_id", "user_id", "props")
    return store.file_samples(events).drop("file_name")


@query("head", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 25")
def head(spark, folder):
    return sources.head(fx.table(spark, folder, "events"), 25).select("event_id", "user_id", "event_type")


@query(
    "latest_shard",
    f"""WITH {fx.EVENT_SPANS} SELECT name, 2 * count(*) AS spans, max(start_time) AS last_start FROM event_spans
    WHERE {fx.shard_sql('start_time', 720)} = '20240115_120000' GROUP BY name""",
)
def latest_shard(spark, folder):
    """The rows of one shard are written a second time, so its folder has old and new files; all of them are the newest shard."""
    path = _lake(spark, folder)
    again = sinks.with_shard(fx.event_spans(spark, folder), 720).where(F.col("shard") == "20240115_120000").drop("shard")
    sinks.write_spans(again, path, 720)
    return sources.latest_shard(spark, path).groupBy("name").agg(F.count("*").alias("spans"), F.max("start_time").alias("last_start"))


@query(
    "access_log_quarantine",
    f"""WITH {fx.LOG} SELECT CASE WHEN event_id % 10 = 3 THEN 'bad' ELSE coalesce(type, 'good') END AS state, count(*) AS lines
    FROM log WHERE event_id % 10 <> 4 GROUP BY 1""",
)
def access_log_quarantine(spark, folder):
    """Written as JSON lines, with every tenth line cut short and every tenth one blank, and read back."""
    path = scratch_path(spark, "log")
    number = F.col("event_id") % 10
    events = fx.table(spark, folder, "events")
    lines = events.select(F.to_json(F.struct(*fx.log_columns())).alias("value"), number.alias("n"))
    spoiled = F.when(F.col("n") == 3, F.substring("value", 1, 25)).when(F.col("n") == 4, "").otherwise(F.col("value"))
    lines.select(spoiled.alias("value")).write.text(path)
    good, bad = sources.split_log(sources.read_access_log(spark, path))
    both = good.select(F.col("type").alias("state")).unionByName(bad.select(F.lit("bad").alias("state")))
    return both.groupBy("state").agg(F.count("*").alias("lines"))


@query("access_log_round_trip", f"WITH {fx.LOG} SELECT type, count(*) AS entries, count(duration_ms) AS timed FROM log GROUP BY type")
def access_log_round_trip(spark, folder):
    path = scratch_path(spark, "log")
    sinks.write_access_log(fx.log(spark, folder), path)
    good, _ = sources.split_log(sources.read_access_log(spark, path))
    return good.groupBy("type").agg(F.count("*").alias("entries"), F.count("duration_ms").alias("timed"))


@query(
    "read_raw_calls",
    f"""WITH {fx.RAW} SELECT CASE WHEN failed THEN 'ERROR' ELSE 'OK' END AS status, count(*) AS calls, min(call_id) AS first_call
    FROM raw GROUP BY 1""",
)
def read_raw_calls(spark, folder):
    path = scratch_path(spark, "raw")
    raw = fx.raw_calls(spark, folder).select("call_id", "kwargs", "response", "error", "start_time", "end_time")
    raw.write.json(path)
    calls = sources.read_raw_calls(spark, path)
    failed = F.col("error").isNotNull() | F.col("response").isNull()
    return calls.groupBy(F.when(failed, "ERROR").otherwise("OK").alias("status")).agg(
        F.count("*").alias("calls"), F.min("call_id").alias("first_call")
    )


@query("capture_lake", CAPTURED)
def capture_lake(spark, folder):
    """Captured spans as the lake gives them back."""
    return captured_columns(fx.captured(spark, folder))


@query(
    "read_model_config",
    """SELECT DISTINCT 'model_' || (conv_id % 3)::VARCHAR AS model_name,
    CASE conv_id % 3 WHEN 0 THEN 'openai/other' WHEN 1 THEN 'openai/Gemini-flash' ELSE 'gemini/pro' END AS target,
    conv_id % 3 = 2 AS drop_params FROM conversations""",
)
def read_model_config(spark, folder):
    path = scratch_path(spark, "models")
    whole = F.struct(F.array_sort(F.collect_list(F.struct("model_name", "litellm_params"))).alias("model_list"))
    fx.models(spark, folder).agg(F.to_json(whole).alias("value")).write.text(path)
    models = sources.read_model_config(spark, path)
    return models.select("model_name", F.col("litellm_params.model").alias("target"), "litellm_params.drop_params")


# --- batches ----------------------------------------------------------------------------------

_ORDINAL = f"""WITH {fx.EVENT_SPANS}, placed AS (SELECT span_id, start_time,
    row_number() OVER (ORDER BY start_time, span_id) - 1 AS ordinal, count(*) OVER () AS n FROM event_spans)"""
@query("batch_assign", f"{_ORDINAL} SELECT span_id, ordinal, ordinal // {_SIZE} AS batch_idx FROM placed")
def batch_assign(spark, folder):
    assigned = batches.assign_batches(fx.event_spans(spark, folder).select("span_id", "start_time"), _SIZE)
    return assigned.select("span_id", "ordinal", "batch_idx")


@query(
    "batch_retain",
    f"""{_ORDINAL} SELECT span_id FROM placed
    WHERE ordinal >= greatest(0, (n - 1) // {_SIZE} - {_KEEP} // {_SIZE}) * {_SIZE}""",
)
def batch_retain(spark, folder):
    kept = batches.retain_batches(fx.event_spans(spark, folder).select("span_id", "start_time"), _SIZE, _KEEP)
    return kept.select("span_id")


@query(
    "collection_status",
    f"""SELECT ((count(*) - 1) % {_SIZE} + 1)::BIGINT AS collected_data_size, least(count(*), {_KEEP})::BIGINT AS total_data_size
    FROM events""",
)
def collection_status(spark, folder):
    return batches.collection_status(fx.table(spark, folder, "events"), _SIZE, _KEEP)


@query(
    "collection_status_without_batches",
    "SELECT count(*) AS collected_data_size, count(*) AS total_data_size FROM events",
)
def collection_status_without_batches(spark, folder):
    return batches.collection_status(fx.table(spark, folder, "events"), 1, 0)


def _batched(spark, folder):
    path = scratch_path(spark, "batches")
    sinks.write_batches(batches.assign_batches(fx.event_spans(spark, folder), _SIZE), path)
    return path


@query(
    "read_batches",
    f"""{_ORDINAL} SELECT ordinal // {_SIZE} AS batch_idx, count(*) AS spans, min(start_time) AS first_start
    FROM placed WHERE ordinal // {_SIZE} IN (1, 3) GROUP BY 1""",
)
def read_batches(spark, folder):
    spans = sources.read_batches(spark, _batched(spark, folder), [1, 3])
    return spans.groupBy(F.col("batch_idx").cast("bigint").alias("batch_idx")).agg(
        F.count("*").alias("spans"), F.min("start_time").alias("first_start")
    )


@query(
    "batch_state",
    f"SELECT ((count(*) - 1) // {_SIZE})::BIGINT AS batch_idx, ((count(*) - 1) % {_SIZE} + 1)::BIGINT AS rows FROM events",
)
def batch_state(spark, folder):
    return store.batch_state(sources.read_spans(spark, _batched(spark, folder)))
