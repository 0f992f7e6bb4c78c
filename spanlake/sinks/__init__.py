"""Batch writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, functions as F

from .. import schemas
from ..functions import attrs_variant, shard_label, with_attrs
from ..operators.sessions import with_date_hour

_PART_COLUMNS = ("shard", "date", "hour", "batch_idx")


def with_shard(spans: DataFrame, window_minutes: int = 5) -> DataFrame:
    """Add the time shard a span belongs to, by its own start time."""
    return spans.withColumn("shard", shard_label(F.col("start_time"), window_minutes))


def with_promoted(spans: DataFrame) -> DataFrame:
    """Add the attributes of ``schemas.PROMOTED`` as columns, from one parse per row; spans that have them keep them."""
    if set(schemas.PROMOTED_NAMES) <= set(spans.columns):
        return spans
    wanted = {"model": "llm.model", "_messages": "llm.request.messages", "_response": "llm.response.content"}
    wanted |= {c: f"llm.usage.{c}" for c in ("prompt_tokens", "completion_tokens", "total_tokens")}
    flags = {
        "is_call": F.col("_messages").isNotNull(),
        "has_response": F.coalesce(F.length("_response") > 0, F.lit(False)),
    }
    return with_attrs(spans.drop(*wanted, *flags), **wanted).withColumns(flags).drop("_messages", "_response")


def lake_writer(spans: DataFrame) -> DataFrameWriter:
    """Writer of span files with bloom filters on the ids, as small as their values allow: a look-up skips row groups whose range holds an id that they do not."""
    # Sizes from 1 MB down by halves: the smallest of the default 5 takes more room than the rows of a small shard.
    writer = spans.write.option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in ("span_id", "rollout_id"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.candidates.number#{column}", "14")
    return writer


def write_spans(spans: DataFrame, path: str, window_minutes: int = 5, variant: bool = False) -> None:
    """Append to the time-sharded lake.

    New files are added, nothing is read back. The rebalance hint groups rows by shard into files of
    the advisory size: small shards share a task, a shard with very many rows is split. Rows are
    sorted by rollout inside a file, so that a rollout filter skips row groups. Model, token counters
    and the call flag become columns. With ``variant`` all attributes are stored once more as a shredded VARIANT column ``attrs``, so
    that readers of any other key need not parse the text.
    """
    spans = spans.withColumn("attrs", attrs_variant(F.col("attributes"))) if variant else spans
    sharded = with_promoted(with_shard(spans, window_minutes)).hint("rebalance", "shard")
    ordered = sharded.sortWithinPartitions("shard", "rollout_id", "start_time")
    lake_writer(ordered).partitionBy("shard").mode("append").parquet(path)


def write_spans_by_hour(spans: DataFrame, path: str) -> None:
    """Append to a lake partitioned by date and hour."""
    dated = with_date_hour(with_promoted(spans)).hint("rebalance", "date", "hour")
    dated.sortWithinPartitions("date", "hour", "rollout_id", "start_time").write.partitionBy("date", "hour").mode("append").parquet(path)


def write_batches(batched: DataFrame, path: str) -> None:
    """Append spans that carry ``batch_idx`` to the numbered-batch lake."""
    columns = [c for c in batched.columns if c != "ordinal"]
    with_promoted(batched.select(*columns)).hint("rebalance", "batch_idx").write.partitionBy("batch_idx").mode("append").parquet(path)


def merge_spans(spans: DataFrame, path: str, target_files: int | None = None) -> None:
    """Compact a lake into files of the advisory size, shard by shard.

    Partition columns, the order inside files and the promoted columns stay as :func:`write_spans` lays them out. ``target_files``
    asks for one folder with a number of files; 1 is for tables that fit one task.
    """
    laid = [c for c in _PART_COLUMNS if c in spans.columns]
    rows = with_promoted(spans)
    if target_files is not None:
        rows.drop(*laid).repartition(target_files).write.mode("errorifexists").parquet(path)
        return
    ordered = rows.hint("rebalance", *laid).sortWithinPartitions(*laid, "rollout_id", "start_time")
    writer = lake_writer(ordered)
    (writer.partitionBy(*laid) if laid else writer).mode("errorifexists").parquet(path)


def write_access_log(log: DataFrame, path: str) -> None:
    """Append as JSON lines. Keys of null fields are left out, text is written as it is."""
    log.write.mode("append").json(path)


def export_parquet(df: DataFrame, path: str) -> None:
    """A finished training set as Parquet."""
    df.write.mode("errorifexists").parquet(path)


def export_splits(train: DataFrame, test: DataFrame, path: str) -> None:
    """A train/test pair below one folder."""
    export_parquet(train, f"{path}/train")
    export_parquet(test, f"{path}/test")
