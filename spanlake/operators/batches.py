"""Numbered batches and rolling retention.

Rows are counted in arrival order. Batch = ordinal div size; with a total of ``keep_rows`` the
current batch and the ``keep_rows div size`` complete batches before it are retained.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .ordinals import counted_ordinal, global_ordinal

ARRIVAL = ("start_time", "span_id")


def assign_batches(df: DataFrame, size: int, order: Sequence[str] = ARRIVAL, first: int = 0) -> DataFrame:
    """Add ``ordinal`` (from ``first``) and ``batch_idx``."""
    numbered = counted_ordinal(df, order)
    ordinal = F.col("ordinal") + first
    return numbered.withColumn("batch_idx", F.floor(ordinal / size).cast("bigint")).withColumn("ordinal", ordinal)


def first_kept(rows: int, size: int, keep_rows: int) -> int:
    """Ordinal of the oldest retained row after ``rows`` rows."""
    if rows <= 0:
        return 0
    return max(0, (rows - 1) // size - keep_rows // size) * size


def expired_batches(current: int, size: int, keep_rows: int) -> int:
    """Batches below this index are expired once ``current`` is being filled."""
    return max(0, current - keep_rows // size)


def retain_batches(
    df: DataFrame, size: int, keep_rows: int, order: Sequence[str] = ARRIVAL, slice_seconds: int = 3600
) -> DataFrame:
    """The retained rows. The first order column must be a number (the time).

    One narrow pass counts rows per time slice; whole slices before the boundary are dropped by a
    filter that reaches the scan, whole slices after it are kept as they are, and only the slice that
    the boundary cuts is numbered.
    """
    # Rows without a time count as the oldest.
    time = F.coalesce(F.col(order[0]), F.lit(-1e15))
    counts = df.groupBy(F.floor(time / slice_seconds).alias("piece")).agg(F.count("*").alias("n"))
    # One row per time slice, whatever the number of rows in it.
    upto = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = counts.select(
        "piece", "n", F.sum("n").over(upto).alias("total"), F.sum("n").over(Window.partitionBy()).alias("rows")
    )
    oldest = (F.floor((F.col("rows") - 1) / size) - keep_rows // size) * size
    boundary = totals.where(F.col("total") > F.greatest(oldest, F.lit(0))).orderBy("piece").first()
    cutoff = 0 if boundary is None else first_kept(boundary["rows"], size, keep_rows)
    if cutoff == 0:
        return df
    low = float(boundary["piece"] * slice_seconds)
    skip = cutoff - (boundary["total"] - boundary["n"])
    inside = df.where((time >= low) & (time < low + slice_seconds))
    after = df.where(F.col(order[0]) >= low + slice_seconds)
    if skip > 0:
        inside = global_ordinal(inside, order, "_place").where(F.col("_place") >= skip).drop("_place")
    return inside.unionByName(after)


def collection_status(df: DataFrame, size: int, keep_rows: int) -> DataFrame:
    """Rows in the current batch and in total (capped at ``keep_rows``); without batches, plain counts."""
    counted = df.agg(F.count("*").alias("n"))
    if keep_rows <= 0:
        return counted.select(F.col("n").alias("collected_data_size"), F.col("n").alias("total_data_size"))
    current = F.when(F.col("n") > 0, (F.col("n") - 1) % size + 1).otherwise(0)
    return counted.select(
        current.cast("bigint").alias("collected_data_size"),
        F.least("n", F.lit(keep_rows)).cast("bigint").alias("total_data_size"),
    )
