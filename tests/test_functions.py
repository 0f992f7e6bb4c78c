import json

import pytest
from pyspark.sql import functions as F

from spanlake import functions as fn


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in TYPES.items() if k in values))
    return row.select(column.alias("x")).first()["x"]


TYPES = {"d": "DOUBLE", "s": "STRING", "e": "STRING", "n": "BIGINT"}


@pytest.mark.parametrize(
    "given, want",
    [
        (None, None),
        (0, None),
        (1704067200, 1704067200.0),
        (1704067200000000000, 1704067200.0),
        (1704067200123, 1704067200123 / 1e9),  # milliseconds are taken for nanoseconds
        (-5, -5.0),
    ],
)
def test_normalize_ts(spark, given, want):
    assert one(spark, fn.normalize_ts(F.col("n")), n=given) == want


@pytest.mark.parametrize(
    "seconds, minutes, want",
    [
        (1772496060.0, 7, "20260303_000000"),  # 00:01, window restarts at midnight
        (1772546400.5, 5, "20260303_140000"),
        (1772547899.9, 30, "20260303_140000"),
        (1772582399.0, 7, "20260303_235500"),
        (0.0, 5, "19700101_000000"),
        (-1.0, 60, "19691231_230000"),
    ],
)
def test_shard_label(spark, seconds, minutes, want):
    assert one(spark, fn.shard_label(F.col("d"), minutes), d=seconds) == want


def test_iso_duration(spark):
    expression = fn.iso_duration_ms(F.col("s"), F.col("e"))
    assert one(spark, expression, s="2024-01-01T00:00:00", e="2024-01-01T00:00:01.250000") == 1250.0
    assert one(spark, expression, s="2024-01-01T00:00:00+08:00", e="2024-01-01T00:00:01") == 1000.0
    assert one(spark, expression, s="never", e="2024-01-01T00:00:01") is None
    assert one(spark, expression, s=None, e="2024-01-01T00:00:01") is None


def test_attributes(spark):
    text = json.dumps({"llm.model": "m", "n": 3, "f": 0.5, "b": True, "list": [1, 2], "plain": "x"})
    assert one(spark, fn.attr(F.col("s"), "llm.model"), s=text) == "m"
    assert one(spark, fn.attr(F.col("s"), "n", "bigint"), s=text) == 3
    assert one(spark, fn.attr(F.col("s"), "f", "double"), s=text) == 0.5
    assert one(spark, fn.attr(F.col("s"), "b", "boolean"), s=text) is True
    assert one(spark, fn.attr(F.col("s"), "plain", "bigint"), s=text) is None
    assert one(spark, fn.attr(F.col("s"), "n"), s="{broken") is None
    assert one(spark, fn.attrs_map(F.col("s")), s=text)["list"] == "[1,2]"
    for bad in ("{broken", "", None, "[1]"):
        assert one(spark, fn.attrs_map(F.col("s")), s=bad) == {}


def test_flatten_content(spark):
    messages = json.dumps(
        [
            {"role": "user", "content": "[1, 2]"},
            {"role": "user", "content": [{"type": "text", "text": "look"}, {"type": "image_url", "image_url": {"url": "h" * 80}}]},
            {"content": None},
            {"role": "tool", "content": "t" * 600, "tool_call_id": "c"},
        ]
    )
    flat = one(spark, fn.flatten_content(F.col("s"), width=500), s=messages)
    assert [tuple(m) for m in flat] == [
        ("user", "[1, 2]"),
        ("user", "look\n[Image: " + "h" * 60 + "...]"),
        ("unknown", ""),
        ("tool", "t" * 500 + "... (truncated)"),
    ]
    assert one(spark, fn.last_content(F.col("s")), s=json.dumps([{"role": "assistant", "content": "a"}])) is None


def test_truncate(spark):
    assert one(spark, fn.truncate_text(F.col("s"), 3), s="abc") == "abc"
    assert one(spark, fn.truncate_text(F.col("s"), 3, "..."), s="abcd") == "abc..."


def test_ids(spark):
    df = spark.createDataFrame([("a", None), ("b", "given")], "k STRING, rollout_id STRING")
    first, second = (fn.with_default_ids(df, ["k"]).orderBy("k").collect() for _ in range(2))
    assert first == second
    assert first[1]["rollout_id"] == "given"
    assert first[0]["rollout_id"].startswith("ro-") and len(first[0]["rollout_id"]) == 15
    assert first[0]["attempt_id"].startswith("at-") and len(first[0]["attempt_id"]) == 11
    random = fn.with_default_ids(df.drop("rollout_id")).select("rollout_id").distinct().count()
    assert random == 2
