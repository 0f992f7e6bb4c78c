"""Structured Streaming forms. The transforms are the batch ones; only state and sinks are added."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions import iso_duration_ms
from ..operators import access_log, batches
from ..sinks import snapshots, with_promoted, with_shard
from ..sources import read_spans, split_log


def stream_table(
    spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", max_files: int | None = None
) -> DataFrame:
    """A folder of Parquet files as a stream; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def _trigger(every: str | None) -> dict:
    """``every`` is the timer flush; without it the query takes what is there and ends."""
    return {"processingTime": every} if every else {"availableNow": True}


def start_span_sink(
    spans: DataFrame, path: str, checkpoint: str, window_minutes: int = 5, every: str | None = None
) -> StreamingQuery:
    """Append a span stream to the time-sharded lake, exactly once."""
    writer = with_promoted(with_shard(spans, window_minutes)).writeStream.partitionBy("shard").format("parquet")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()


def _query_id(batch: DataFrame) -> str:
    """Id of the running query; its checkpoint keeps it over restarts."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def start_lake_sink(
    spans: DataFrame,
    path: str,
    checkpoint: str,
    window_minutes: int = 5,
    every: str | None = None,
    max_files: int | None = None,
    fan_in: int = 8,
    failing: Callable[[int], None] | None = None,
    keep_versions: int | None = None,
) -> StreamingQuery:
    """Append a span stream to a lake with a manifest, exactly once, and compact it on the way.

    A micro-batch is grouped by shard and sorted as :func:`spanlake.sinks.write_spans` does, written to a folder of its own, and
    committed with its number; a replay of a committed one is left out. Small folders are joined while readers and the stream go on. Read with :func:`read_lake`.
    ``shard`` is a column that the files are sorted by, so that a filter on it skips row groups: a micro-batch has files of the advisory size, however many shards
    it meets. ``failing`` is called between write and commit (see :mod:`spanlake.sinks.snapshots`). With ``keep_versions`` the folders that
    only older versions name are deleted; without it they stay for readers of these.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        laid = _laid_out(with_promoted(with_shard(batch, window_minutes)))
        snapshots.append(laid, path, _query_id(batch), epoch, failing=failing)
        compact_lake(batch.sparkSession, path, fan_in)
        if keep_versions is not None:
            snapshots.vacuum(batch.sparkSession, path, keep_versions)

    writer = spans.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(every)).start()


def _laid_out(spans: DataFrame) -> DataFrame:
    return spans.hint("rebalance", "shard").sortWithinPartitions("shard", "rollout_id", "start_time")


def compact_lake(spark: SparkSession, path: str, fan_in: int = 8) -> snapshots.Snapshot:
    """Join the small folders of a lake with a manifest; readers see the state before or after."""
    return snapshots.compact(spark, path, _laid_out, fan_in=fan_in)


def read_lake(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Spans of one version of such a lake, with ``shard`` and the promoted columns."""
    return snapshots.read(spark, path, version, f"{schemas.SPAN}, {schemas.PROMOTED}, shard STRING")


def lake_stats(spark: SparkSession, path: str) -> dict[str, int | str | None]:
    """Counters over the whole life of a lake, whatever was restarted: spans added and flushed, micro-batches, live folders, newest shard."""
    now = snapshots.snapshot(spark, path)
    told = list(now.streams.values())
    newest = read_lake(spark, path, now.version).agg(F.max("shard")).first()[0] if now.folders else None
    return {
        "spans_added": sum(t["rows"] for t in told),
        "spans_flushed": sum(f.rows for f in now.folders),
        "micro_batches": sum(t["micro_batches"] for t in told),
        "folders": len(now.folders),
        "current_shard": newest,
    }


def start_upsert_sink(df: DataFrame, path: str, checkpoint: str, keys: list[str], every: str | None = None) -> StreamingQuery:
    """Keep the current rows of a streaming aggregate below ``path``: each micro-batch writes the keys that changed (update mode).

    State that the watermark drops stays in the table. Read with :func:`read_upserts`.
    """

    def replace(batch: DataFrame, epoch: int) -> None:
        snapshots.upsert(batch, path, keys, _query_id(batch), epoch)

    writer = df.writeStream.outputMode("update").foreachBatch(replace)
    return writer.option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()


def read_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key."""
    return snapshots.read_upserts(spark, path, keys)


def start_append_sink(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append the rows of a stream as Parquet files."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()


def start_split_sink(
    lines: DataFrame, path: str, quarantine: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, every: str | None = None
) -> StreamingQuery:
    """Readable rows of ``lines`` to one table and the text of broken lines to another, in one query and exactly once.

    ``lines`` has ``_corrupt_record`` (see :func:`spanlake.sources.read_access_log`). Both tables have a manifest (:mod:`spanlake.sinks.snapshots`): a micro-batch that failed between
    its two commits is written again, and the table that has it already leaves it out. ``transform`` is applied to the readable rows.
    """

    def split(batch: DataFrame, epoch: int) -> None:
        query = _query_id(batch)
        good, bad = split_log(batch.persist())
        try:
            snapshots.append(transform(good) if transform else good, path, query, epoch)
            snapshots.append(bad, quarantine, query, epoch)
        finally:
            batch.unpersist()

    writer = lines.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(every)).start()


def run(start: Callable[..., StreamingQuery], df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is available and wait for the end."""
    start(df, path, checkpoint).awaitTermination()


def sink_stats(query: StreamingQuery) -> dict[str, int]:
    """Rows and micro-batches of the recent progress of a query."""
    progress = [p for p in query.recentProgress if p.numInputRows]
    return {"spans_added": sum(p.numInputRows for p in progress), "micro_batches": len(progress)}


def shard_counts(spans: DataFrame, window_minutes: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """Spans per tumbling time shard, to be kept by ``shard`` (:func:`start_upsert_sink`).

    Shards restart at midnight, so each lies in one day; the window of the day (or of the shard, where the width divides the day) lets the watermark drop its state.
    """
    timed = with_shard(spans.withColumn("at", F.timestamp_seconds("start_time")), window_minutes)
    width = f"{window_minutes} minutes" if 1440 % window_minutes == 0 else "1 day"
    counted = timed.withWatermark("at", lateness).groupBy(F.window("at", width), "shard").count()
    return counted.select("shard", F.col("count").alias("spans"))


def _log_windows(log: DataFrame, width: str, lateness: str) -> DataFrame:
    return log.withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", lateness)


def live_counts(log: DataFrame, key: Column, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Entries per window and ``key`` (by its name), to be kept by both; :func:`total_counts` adds the windows up.

    State is that of the windows which the watermark has not passed, however long the stream runs.
    """
    timed = _log_windows(log, width, lateness)
    return timed.groupBy(F.window("at", width).alias("w"), key).count().select(F.col("w.start").alias("window_start"), F.col("*")).drop("w")


def total_counts(kept: DataFrame, key: str) -> DataFrame:
    return kept.groupBy(key).agg(F.sum("count").alias("count"))


def live_summary(log: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Parts of the log summary per window, to be kept by ``window_start``; :func:`total_summary` folds them."""
    timed = _log_windows(log, width, lateness)
    waited = F.when(F.col("type") == "response", F.col("duration_ms"))
    stamp = F.when(F.length("timestamp") > 0, F.col("timestamp"))
    parts = timed.groupBy(F.window("at", width).alias("w")).agg(
        F.count("*").alias("entries"),
        F.min(stamp).alias("start"),
        F.max(stamp).alias("end"),
        F.count_if(F.col("type") == "request").alias("requests"),
        F.count_if(F.col("type") == "response").alias("responses"),
        F.count_if(access_log.is_error()).alias("errors"),
        F.sum(waited).alias("sum_ms"),
        F.count(waited).alias("timed"),
        F.min(waited).alias("min_ms"),
        F.max(waited).alias("max_ms"),
    )
    return parts.select(F.col("w.start").alias("window_start"), "*").drop("w")


def total_summary(kept: DataFrame) -> DataFrame:
    return kept.agg(
        F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"),
        F.coalesce(F.min("start"), F.lit("N/A")).alias("start"),
        F.coalesce(F.max("end"), F.lit("N/A")).alias("end"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("requests", "responses", "errors")],
        F.coalesce(F.sum("sum_ms") / F.sum("timed"), F.lit(0.0)).alias("avg_ms"),
        F.min("min_ms").alias("min_ms"),
        F.max("max_ms").alias("max_ms"),
    )


def _digest() -> Column:
    return F.sha2(F.to_json(F.struct("*")), 256)


def _packed(log: DataFrame) -> Column:
    """A whole entry that sets and sorts can hold; they cannot hold maps."""
    return F.struct(*[F.map_entries(c).alias(c) if t.startswith("map<") else F.col(c) for c, t in log.dtypes]).alias("row")


def _unpacked(log: DataFrame) -> list[Column]:
    """The columns of ``log`` from its packed ``row``."""
    return [(F.map_from_entries(f"row.{c}") if t.startswith("map<") else F.col(f"row.{c}")).alias(c) for c, t in log.dtypes]


def _events(requests: DataFrame, responses: DataFrame, lateness: str, *carried: Column) -> DataFrame:
    """All entries with an id, as ``id``, ``at``, ``kind`` (0: request) and ``asked``, what a response is told of its request; responses with what is ``carried``."""
    sides = []
    for log, kind in ((requests, 0), (responses, 1)):
        told = F.struct("timestamp", "method", "path") if kind == 0 else F.lit(None)
        rows = [c if kind == 1 else F.lit(None).alias("row") for c in carried]
        named = log.where(F.col("request_id").isNotNull())
        sides.append(named.select(F.col("request_id").alias("id"), F.to_timestamp("timestamp").alias("at"), F.lit(kind).alias("kind"), told.alias("asked"), *rows))
    return sides[0].unionByName(sides[1]).withWatermark("at", lateness)


def _answer(entries: str, place: Column) -> Column:
    """Whether there is a response at this place."""
    return F.coalesce(F.get(entries, place)["kind"] == 1, F.lit(False))


#: Steps that ``max_wait`` is cut into to link responses.
_LINK_STEPS = 256


def correlate_stream(
    requests: DataFrame, responses: DataFrame, lateness: str = "1 hour", max_wait: str = "2 hours"
) -> DataFrame:
    """Every response with its request: the last event with its id within ``max_wait`` before it, if that is a request.

    At one time a request comes before a response; so a request is used up by the first response after it, as in :func:`spanlake.operators.access_log.correlate_log`. Equal responses of
    one id (replays) are one; those without an id meet nobody and pass by.

    No event is joined. Time is cut into steps of 1/256 of ``max_wait``: the events of an id in a step are put in order, and the last event before a step is found among those that end the
    id's steps, at most 512 of them. So an id that comes back k times costs k rows. A response is told at the end of the span of ``max_wait`` that it lies in, once the watermark passes it.
    """
    bare = responses.drop("request_method", "request_path", "duration_ms")
    wait = _seconds(requests.sparkSession, max_wait)
    step = max(1, math.ceil(wait / _LINK_STEPS))
    # Spans are whole steps, and no shorter than the wait.
    span = step * max(1, math.ceil(wait / step))

    def step_of(at: str) -> Column:
        second = F.unix_seconds(at)
        return (second - F.pmod(second, F.lit(step))).alias("step")

    entry = F.struct("at", "kind", "asked", "row").alias("entry")
    entries = _events(requests, bare, lateness, _packed(bare)).select(F.window("at", f"{span} seconds").alias("span"), "id", step_of("at"), entry)
    entries = entries.select(F.window_time("span").alias("until"), "id", "step", "entry", F.lit(None).alias("before"))

    # The last event of each step, and the one before it, in the same span or the one before.
    end = F.struct("at", "kind", "asked")
    ends = _events(requests, bare, lateness).groupBy(F.window("at", f"{step} seconds").alias("step"), "id").agg(F.max(end).alias("end"))
    ends = ends.select(F.window_time("step").alias("step_end"), "id", "end")
    ends = ends.groupBy(F.window("step_end", f"{2 * span} seconds", f"{span} seconds").alias("spans"), "id").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    follows = F.explode(F.arrays_zip("ends", F.concat(F.array(F.lit(None)), "ends").alias("before"))).alias("end")
    ends = ends.select(F.window_time("spans").alias("until"), F.col("spans.end").alias("spans_end"), "id", follows).select("until", "spans_end", "id", "end.*")
    own = F.col("ends.at") >= F.col("spans_end") - F.expr(f"interval {span} seconds")
    before = ends.where(own & F.col("before").isNotNull()).select("until", "id", step_of("ends.at"), F.lit(None).alias("entry"), "before")

    met = entries.unionByName(before).groupBy("until", "id", "step").agg(F.sort_array(F.collect_set("entry")).alias("entries"), F.max("before").alias("before"))
    # Responses of one time stand together, and the same event is before them all.
    first = F.filter(
        F.sequence(F.lit(0), F.size("entries") - 1),
        lambda i: _answer("entries", i) & ~(_answer("entries", i - 1) & (F.get("entries", i - 1)["at"] == F.get("entries", i)["at"])),
    )
    met = met.where(F.size("entries") > 0).select("entries", "before", first.alias("first"))
    after = F.concat(F.slice("first", 2, F.size("first")), F.array(F.size("entries"))).alias("after")

    def run(place: Column) -> Column:
        here = F.filter(F.slice("entries", place["first"] + 1, place["after"] - place["first"]), lambda entry: entry["kind"] == 1)
        last = F.get("entries", place["first"] - 1)
        last = F.when(place["first"] > 0, F.struct(*[last[c].alias(c) for c in ("at", "kind", "asked")])).otherwise(F.col("before"))
        return F.struct(F.get("entries", place["first"])["at"].alias("at"), here["row"].alias("rows"), last.alias("last"))

    met = met.select("entries", "before", F.arrays_zip("first", after).alias("places")).select(F.explode(F.transform("places", run)).alias("run")).select("run.*")
    asked = F.when(F.col("last.at") >= F.col("at") - F.expr(f"interval {max_wait}"), F.col("last.asked"))
    linked = met.select(F.explode("rows").alias("row"), asked.alias("asked"))
    linked = linked.select(*_unpacked(bare), *[F.col(f"asked.{c}").alias(f"request_{c}") for c in ("method", "path", "timestamp")])
    linked = linked.unionByName(bare.where(F.col("request_id").isNull()), allowMissingColumns=True)
    return linked.withColumn("duration_ms", iso_duration_ms(F.col("request_timestamp"), F.col("timestamp")))


#: Steps that ``max_wait`` is cut into to find open requests.
_STEPS = 32


def _seconds(spark: SparkSession, interval: str) -> float:
    return spark.sql(f"SELECT CAST(timestamp_seconds(0) + interval {interval} AS DOUBLE)").first()[0]


def open_requests_stream(
    requests: DataFrame, responses: DataFrame, lateness: str = "1 hour", max_wait: str = "2 hours"
) -> DataFrame:
    """Requests that nothing with their id follows within ``max_wait``; equal requests (replays) are one.

    Time is cut into steps of 1/32 of ``max_wait``. Of an id's events in a step only the last ones may be left open, and only the first matters to earlier steps; so an id that comes
    back k times meets itself at most 33 times per step, not k times per request. A request is told once the watermark is ``max_wait`` and two steps past it.
    """
    spark = requests.sparkSession
    step = max(1, int(_seconds(spark, max_wait) // _STEPS))
    sides = []
    for log, kind in ((requests, 0), (responses.where(F.col("request_id").isNotNull()), 1)):
        own = F.coalesce("request_id", F.concat(F.lit("\x00"), _digest())) if kind == 0 else F.col("request_id")
        sides.append((log, F.to_timestamp("timestamp").alias("at"), own.alias("id"), F.lit(kind).alias("kind")))

    def window() -> Column:
        return F.window("at", f"{step} seconds").alias("step")

    def entries(carried: bool) -> DataFrame:
        rows = [log.select(*told, *([_packed(requests) if k == 0 else F.lit(None).alias("row")] if carried else [])) for k, (log, *told) in enumerate(sides)]
        return rows[0].unionByName(rows[1]).withWatermark("at", lateness)

    # Requests of one id and time, and whether a response came at that time.
    same = entries(True).groupBy("at", "id").agg(F.max("kind").alias("kind"), F.collect_set("row").alias("rows"))
    last = same.groupBy(window(), "id").agg(F.max("at").alias("asked_at"), F.max_by(F.struct("kind", "rows"), "at").alias("end")).where("end.kind = 0")
    last = last.select(F.window_time("step").alias("until"), "id", "asked_at", F.col("end.rows").alias("rows"))
    first = entries(False).groupBy(window(), "id").agg(F.min("at").alias("event_at"))
    first = first.select(F.window_time("step").alias("event_until"), F.col("id").alias("event_id"), "event_at")
    wait = F.expr(f"interval {max_wait}")
    later = (F.col("event_until") > F.col("until")) & (F.col("event_until") <= F.col("until") + wait + F.expr(f"interval {step} seconds"))
    joined = last.join(first, (F.col("id") == F.col("event_id")) & later & (F.col("event_at") <= F.col("asked_at") + wait), "left")
    left = joined.where(F.col("event_id").isNull()).select(F.explode("rows").alias("row"))
    return left.select(*_unpacked(requests))


def drop_duplicate_spans(spans: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """One row per span id among the rows that are at most ``lateness`` apart."""
    timed = spans.withColumn("at", F.timestamp_seconds("start_time")).withWatermark("at", lateness)
    return timed.dropDuplicatesWithinWatermark(["span_id"]).drop("at")


def start_batch_sink(
    spans: DataFrame,
    path: str,
    checkpoint: str,
    size: int,
    keep_rows: int,
    every: str | None = None,
    delete: bool = False,
) -> StreamingQuery:
    """Append to numbered batches of ``size`` rows.

    A micro-batch goes to ``batch_idx=<b>/epoch=<id>`` and replaces only its own folders, so a replay
    after a failure gives the same files. Counting goes on from the rows of earlier epochs, which is
    all that a restart needs. Expired batches are left to readers (:func:`retained`) unless ``delete``
    is on; then their folders are removed after the write, and those that a micro-batch both fills and expires are not written.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        first = _rows_before(spark, path, size, epoch)
        numbered = batches.assign_batches(batch, size, first=first).drop("ordinal")
        if delete:
            # Batches that this very micro-batch fills and expires are not put down first.
            current = (first + batch.count() - 1) // size
            numbered = numbered.where(F.col("batch_idx") >= batches.expired_batches(current, size, keep_rows))
        laid = with_promoted(numbered).hint("rebalance", "batch_idx")
        laid.withColumn("epoch", F.lit(epoch)).write.partitionBy("batch_idx", "epoch").mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(path)
        if delete:
            lake = _lake_or_none(spark, path)
            present = [] if lake is None else [r[0] for r in lake.select("batch_idx").distinct().collect()]
            for index in expired(present, size, keep_rows):
                snapshots.delete(spark, f"{path}/batch_idx={index}")

    writer = spans.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(every)).start()


def _lake_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    lake = read_spans(spark, path)
    return lake if "batch_idx" in lake.columns else None


def _rows_before(spark: SparkSession, path: str, size: int, epoch: int) -> int:
    """Rows ever written by earlier epochs, from the highest batch alone."""
    lake = _lake_or_none(spark, path)
    if lake is None:
        return 0
    earlier = lake.where(F.col("epoch") < epoch)
    # The largest folder number first, then the rows of that batch alone.
    last = earlier.agg(F.max("batch_idx")).first()[0]
    return 0 if last is None else last * size + earlier.where(F.col("batch_idx") == last).count()


def expired(present: list[int], size: int, keep_rows: int) -> list[int]:
    """Batch numbers that rolling retention no longer keeps."""
    if not present:
        return []
    oldest = batches.expired_batches(max(present), size, keep_rows)
    return sorted(b for b in present if b < oldest)


def retained(spark: SparkSession, path: str, size: int, keep_rows: int) -> DataFrame:
    """The rows that retention keeps, whether or not expired folders were removed yet."""
    lake = read_spans(spark, path)
    current = lake.agg(F.max("batch_idx")).first()[0] or 0
    return lake.where(F.col("batch_idx") >= batches.expired_batches(current, size, keep_rows))
