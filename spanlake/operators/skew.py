"""Handling of keys that hold a large part of the rows.

The split is exact for any choice of heavy keys, so finding them may be approximate: one pass over
the key columns with a fixed-size sketch per task, whose result is at most ``limit`` numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

HEAVY_ROWS_CONF = "spanlake.skew.heavyRows"
HEAVY_ROWS = 250_000
TRACKED = 65_536


def _digest(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def heavy_keys(df: DataFrame, keys: Sequence[str], limit: int = 4096) -> list[int]:
    """Digests of the keys with at least ``spanlake.skew.heavyRows`` rows, most frequent first."""
    least = int(df.sparkSession.conf.get(HEAVY_ROWS_CONF, str(HEAVY_ROWS)))
    top = df.select(_digest(keys).alias("key")).agg(F.expr(f"approx_top_k(key, {limit}, {TRACKED})").alias("top"))
    found = top.first()["top"] or []
    return [entry["item"] for entry in found if entry["count"] >= least]


def split_heavy(df: DataFrame, keys: Sequence[str], heavy: list[int]) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys and rows of heavy keys."""
    hit = _digest(keys).isin(heavy)
    return df.where(~hit), df.where(hit)


def join_unique(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", heavy: list[int] | None = None
) -> DataFrame:
    """``left``, ``left_anti`` or ``left_semi`` equi-join to a side that has one row per key.

    Rows of heavy left keys (null included) are joined to a broadcast of their at most 256 partner
    rows instead of being shuffled to one task; all other rows take the normal join. A caller that
    knows the heavy keys (none: ``[]``) passes them.
    """
    keys = list(keys)
    if heavy is None:
        heavy = heavy_keys(left, keys, limit=256)
    if not heavy:
        return left.join(right, keys, how)
    normal, hot = split_heavy(left, keys, heavy)
    partners = right.where(_digest(keys).isin(heavy))
    return normal.join(right, keys, how).unionByName(hot.join(F.broadcast(partners), keys, how))
