import random
from datetime import datetime

import pytest
from pyspark.sql import Window, functions as F

from spanlake.operators import batches
from spanlake.operators.ordinals import counted_ordinal, global_ordinal


def simulated(rows, size, keep_rows):
    """Rows a store keeps that opens a batch when the current one is full and then deletes one old batch."""
    kept, batch, collected = {0: []}, 0, 0
    for row in range(rows):
        if collected >= size:
            batch, collected = batch + 1, 0
            kept[batch] = []
            kept.pop(batch - keep_rows // size - 1, None)
        kept[batch].append(row)
        collected += 1
    return [r for b in sorted(kept) for r in kept[b]], collected


@pytest.mark.parametrize("size, keep", [(2, 6), (2, 10), (3, 3), (3, 7), (5, 4), (1, 1)])
def test_cutoff(size, keep):
    for rows in range(0, 40):
        kept, collected = simulated(rows, size, keep)
        assert list(range(batches.first_kept(rows, size, keep), rows)) == kept
        assert len(kept) <= (keep // size + 1) * size


def events(spark, times):
    return spark.createDataFrame([(float(t), f"s{i:05d}") for i, t in enumerate(times)], "start_time DOUBLE, span_id STRING")


@pytest.mark.parametrize("size, keep", [(2, 6), (7, 50), (10, 1000), (3, 0)])
def test_retention(spark, size, keep):
    random.seed(size)
    times = [random.choice([100.0, 3700.0, 3700.0, 3700.0, 8000.0, 9e8]) for _ in range(200)]
    spans = events(spark, times)
    ordered = [f"s{i:05d}" for t, i in sorted((t, i) for i, t in enumerate(times))]
    kept = [r["span_id"] for r in batches.retain_batches(spans, size, keep).collect()]
    assert sorted(kept) == sorted(ordered[batches.first_kept(200, size, keep):])
    assigned = batches.assign_batches(spans, size)
    got = {r["span_id"]: (r["ordinal"], r["batch_idx"]) for r in assigned.collect()}
    assert got == {s: (n, n // size) for n, s in enumerate(ordered)}


def test_status(spark):
    for rows, want in [(0, (0, 0)), (1, (1, 1)), (4, (2, 4)), (7, (1, 6)), (8, (2, 6))]:
        assert tuple(batches.collection_status(spark.range(rows), 2, 6).first()) == want
    assert tuple(batches.collection_status(spark.range(9), 2, 0).first()) == (9, 9)


def test_copies_are_spread(spark):
    """A group of equal rows is split over partitions, and every place is given once."""
    rows = spark.range(0, 3000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    placed = global_ordinal(rows, ["k"])
    assert [r[0] for r in placed.select("ordinal").orderBy("ordinal").collect()] == list(range(3000))
    assert placed.orderBy("ordinal").select("k").collect() == rows.orderBy("k").collect()


ODD = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.7e308, -1.7e308, 5e-324, 1.0, 1.0 + 2**-52]


def places(spark, times, kind="DOUBLE"):
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(times)], f"t {kind}, i INT").repartition(5)
    window = Window.orderBy("t", "i")
    want = rows.select("t", "i", (F.row_number().over(window) - 1).alias("ordinal"))
    got = counted_ordinal(rows, ["t", "i"])
    assert got.columns == ["t", "i", "ordinal"]
    return sorted(got.select("i", "ordinal").collect()), sorted(want.select("i", "ordinal").collect())


def odd_times(seed):
    rng = random.Random(seed)
    return [rng.choice(ODD + [rng.gauss(1.7e9, 1e5), rng.uniform(-5, 5)]) for _ in range(300)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counted_places(spark, seed):
    got, want = places(spark, odd_times(seed))
    assert got == want
    near = [1.7e9 + random.Random(seed).random() for _ in range(50)] * 3
    got, want = places(spark, near)
    assert got == want


def test_counted_places_of_hot_slices(spark, heavy):
    got, want = places(spark, odd_times(4))
    assert got == want
    # One far time puts all others into one slice.
    got, want = places(spark, [1e15] + [float(i % 7) for i in range(200)])
    assert got == want


def test_counted_places_of_other_types(spark):
    whole = [None, 2**62, 2**62 + 1, 2**62 - 1, -(2**62), 0, 0]
    got, want = places(spark, whole * 3, "BIGINT")
    assert got == want
    got, want = places(spark, ["b", "a", None, "c", "a"], "STRING")
    assert got == want
    times = [datetime(2024, 1, 1), None, datetime(1969, 5, 1), datetime(2024, 1, 1, 0, 0, 0, 1), datetime(2024, 1, 1)]
    for kind in ("TIMESTAMP", "TIMESTAMP_NTZ"):
        got, want = places(spark, times, kind)
        assert got == want


def test_wide_rows_move_once(spark):
    rows = spark.range(1000).select(F.col("id").cast("double").alias("start_time"), F.col("id").cast("string").alias("span_id"), F.lit("x").alias("wide"))
    plan = batches.assign_batches(rows, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_slice") == 1
    assert "rangepartitioning" not in plan and "Exchange SinglePartition" not in plan


def test_empty(spark):
    assert counted_ordinal(spark.createDataFrame([], "t DOUBLE"), ["t"]).count() == 0
    assert global_ordinal(spark.range(0), ["id"]).count() == 0
    none = spark.createDataFrame([], "start_time DOUBLE, span_id STRING")
    assert batches.retain_batches(none, 2, 2).count() == 0
