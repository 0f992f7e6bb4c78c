"""Identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Prefix and number of hex digits.
ROLLOUT = ("ro-", 12)
ATTEMPT = ("at-", 8)


def _digest(key_cols: Sequence[str], salt: str) -> Column:
    if not key_cols:
        return F.replace(F.uuid(), F.lit("-"), F.lit(""))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]
    return F.sha2(F.concat_ws("|", F.lit(salt), *parts), 256)


def with_default_ids(df: DataFrame, key_cols: Sequence[str] = ()) -> DataFrame:
    """Fill missing ``rollout_id`` / ``attempt_id``.

    With key columns the ids are a digest of them, so a replayed job gives the same ids; without
    keys they are random.
    """
    for column, (prefix, digits) in {"rollout_id": ROLLOUT, "attempt_id": ATTEMPT}.items():
        made = F.concat(F.lit(prefix), F.substring(_digest(key_cols, column), 1, digits))
        present = F.col(column) if column in df.columns else F.lit(None).cast("string")
        df = df.withColumn(column, F.coalesce(present, made))
    return df


def call_ids(call_id: Column) -> tuple[Column, Column]:
    """Repeatable trace id (32 hex) and span id (16 hex) of a captured call."""
    digest = F.sha2(call_id, 256)
    return F.substring(digest, 1, 32), F.substring(digest, 33, 16)
