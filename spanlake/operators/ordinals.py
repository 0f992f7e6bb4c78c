"""Row numbers over a total order without sending a whole table or group through one task.

Rows are range-partitioned on the order, so equal ranges of it go to different tasks whatever the
key distribution. The position inside a partition plus the number of rows in earlier partitions is
the ordinal. A checkpoint fixes the partitioning before it is counted, and cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType, TimestampNTZType, TimestampType

from ..session import shared_dir
from .skew import HEAVY_ROWS, HEAVY_ROWS_CONF, heavy_keys, split_heavy

_TIE, _POS, _PART = "_tie", "_pos", "_part"
# monotonically_increasing_id keeps the partition in the upper bits and the row in the lower 33.
_ROW_BITS = 33
#: Most slices that the first order column is cut into.
SLICES = 1 << 18


def _range_positions(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with their range partition and their place in it. Copies of a row may be split, too."""
    spark = df.sparkSession
    shared_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        df.withColumn(_TIE, F.monotonically_increasing_id())
        .repartitionByRange(parts, *order, _TIE)
        .sortWithinPartitions(*order, _TIE)
        .withColumn(_POS, F.monotonically_increasing_id())
        .drop(_TIE)
        .checkpoint()
        .withColumn(_PART, F.shiftright(_POS, _ROW_BITS))
        .withColumn(_POS, F.col(_POS).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    )


def global_ordinal(df: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Add the 0-based place of each row in the whole table."""
    placed = _range_positions(df, order)
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition: bounded by spark.sql.shuffle.partitions.
    starts = placed.groupBy(_PART).agg(F.count("*").alias("_n")).select(
        _PART, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    return (
        placed.join(F.broadcast(starts), _PART)
        .withColumn(name, F.col("_start") + F.col(_POS))
        .drop(_PART, _POS, "_start")
    )


def _slice_of(order: Column, low: float, width: float) -> Column:
    """Number of the slice, which never falls while ``order`` rises: nulls, then what is below ``low``, the slices, and last infinity and NaN."""
    inside = F.floor(F.least((order - low) / width, F.lit(SLICES - 1.0))) + 1
    far = F.isnan(order) | (order == float("inf"))
    return F.when(order.isNull(), -1).when(far, SLICES + 1).when(order < low, 0).otherwise(inside).cast("bigint")


def counted_ordinal(df: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Add the 0-based place of each row in the whole table, as :func:`global_ordinal` does, and move each row once.

    The range of the first order column (a number or a time) is cut into :data:`SLICES` slices. Two passes over that column alone give the range and
    the rows per slice; their running sum, at most ``SLICES + 3`` numbers, is where each slice starts, and a window numbers the rows inside.
    Only the rows of slices that hold at least ``spanlake.skew.heavyRows`` of them (equal times, or a range that a few outliers stretch) are range-partitioned.
    """
    order = list(order)
    if not isinstance(df.schema[order[0]].dataType, (NumericType, TimestampType, TimestampNTZType)):
        return global_ordinal(df, order, name)
    first = F.col(order[0])
    if isinstance(df.schema[order[0]].dataType, TimestampNTZType):
        first = first.cast("timestamp")
    first = first.cast("double")
    finite = F.when(F.abs(first) < float("inf"), first)
    low, high = df.agg(F.min(finite), F.max(finite)).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    # Halves first, as the range itself may be infinite.
    width = max((high / 2 - low / 2) / SLICES * 2, 5e-324)
    rows = df.withColumn("_slice", _slice_of(first, low, width))
    # At most SLICES + 3 rows.
    counts = sorted(rows.groupBy("_slice").count().collect())
    least = int(df.sparkSession.conf.get(HEAVY_ROWS_CONF, str(HEAVY_ROWS)))
    hot = [n if n >= least else 0 for _, n in counts]
    starts = list(accumulate((n for _, n in counts), initial=0))[:-1]
    hot_starts = list(accumulate(hot, initial=0))[:-1]
    table = {"_slice": [s for s, _ in counts], "_from": starts, "_hot": [h > 0 for h in hot], "_before": hot_starts}
    kinds = [("_slice", pa.int64()), ("_from", pa.int64()), ("_hot", pa.bool_()), ("_before", pa.int64())]
    table = F.broadcast(df.sparkSession.createDataFrame(pa.table(table, pa.schema(kinds))))
    rows = rows.join(table, "_slice")
    inside = Window.partitionBy("_slice").orderBy(*order)
    plain = (rows.where("NOT _hot") if any(hot) else rows).withColumn("_place", F.row_number().over(inside) - 1)
    if any(hot):
        # The place among the rows of all hot slices, less the rows of the hot slices before.
        far = global_ordinal(rows.where("_hot"), order, "_place").withColumn("_place", F.col("_place") - F.col("_before"))
        plain = plain.unionByName(far)
    return plain.withColumn(name, (F.col("_from") + F.col("_place")).cast("bigint")).select(*df.columns, name)


def group_ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, heavy: list[int] | None = None
) -> DataFrame:
    """Add the 0-based place of each row in its group.

    Ordinary groups use a window. Groups with very many rows are range-partitioned on their order,
    so that each task numbers only a piece of such a group.
    """
    keys, order = list(keys), list(order)
    in_group = Window.partitionBy(*keys).orderBy(*order)
    if heavy is None:
        heavy = heavy_keys(df, keys)
    if not heavy:
        return df.withColumn(name, (F.row_number().over(in_group) - 1).cast("bigint"))
    normal, hot = split_heavy(df, keys, heavy)
    placed = _range_positions(hot, [*keys, *[c for c in order if c not in keys]])
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition and heavy group in it: bounded by the partitions plus the heavy list.
    pieces = placed.groupBy(_PART, *keys).agg(F.min(_POS).alias("_first"), F.count("*").alias("_n"))
    pieces = pieces.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"))
    same = [F.col(f"r.{_PART}") == F.col(f"p.{_PART}")]
    same += [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    numbered = placed.alias("r").join(F.broadcast(pieces.alias("p")), same).select(
        *[F.col(f"r.{c}") for c in df.columns],
        (F.col("p._start") + F.col(f"r.{_POS}")).cast("bigint").alias(name),
    )
    plain = normal.withColumn(name, (F.row_number().over(in_group) - 1).cast("bigint"))
    return plain.unionByName(numbered)


def _null_safe(left: str, right: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def slice_ordinal(df: DataFrame, keys: Sequence[str], piece: Column, order: Sequence[str], name: str) -> DataFrame:
    """Add the 0-based place of each row in its group, counted slice by slice.

    ``piece`` must not fall while ``order`` rises. Slices are numbered apart and start where the earlier slices of the group end,
    so a task holds slices, not groups; the starts come from one narrow count per group and slice.
    """
    keys = list(keys)
    rows = df.withColumn("_piece", piece)
    counts = rows.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # The first slice of a group starts at 0, so only groups of several slices meet the table of starts.
    starts = counts.withColumn("_start", F.sum("_n").over(earlier)).where(F.col("_start").isNotNull())
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order)
    placed = rows.withColumn("_place", F.row_number().over(inside) - 1)
    joined = placed.alias("r").join(starts.alias("s"), _null_safe("r", "s", [*keys, "_piece"]), "left")
    place = (F.coalesce("s._start", F.lit(0)) + F.col("r._place")).cast("bigint")
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], place.alias(name))


def event_before(df: DataFrame, keys: Sequence[str], piece: Column, order: Sequence[str], value: Column, name: str, after: bool = False) -> DataFrame:
    """Add ``value`` of the row before (or ``after``) each row in its group, null at the end.

    Rows look in their own slice first; the last (first) value of each slice, one narrow row, serves the rows at its edge.
    """
    keys = list(keys)
    direction = [F.col(c).desc() for c in order] if after else [F.col(c).asc() for c in order]
    rows = df.withColumn("_piece", piece).withColumn("_value", value)
    edge = F.min_by if after else F.max_by
    edges = rows.groupBy(*keys, "_piece").agg(edge("_value", F.struct(*order)).alias("_edge"))
    along = Window.partitionBy(*keys).orderBy(F.col("_piece").desc() if after else F.col("_piece").asc())
    edges = edges.withColumn("_edge", F.lag("_edge").over(along)).where(F.col("_edge").isNotNull())
    inside = Window.partitionBy(*keys, "_piece").orderBy(*direction)
    near = rows.withColumn("_near", F.lag("_value").over(inside)).withColumn("_nth", F.row_number().over(inside))
    joined = near.alias("r").join(edges.alias("e"), _null_safe("r", "e", [*keys, "_piece"]), "left")
    found = F.when(F.col("r._nth") == 1, F.col("e._edge")).otherwise(F.col("r._near"))
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], found.alias(name))
