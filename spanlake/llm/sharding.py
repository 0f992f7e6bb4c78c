"""Sharding: groups of equal texts go to shards by longest-processing-time scheduling.

Groups are sorted by size and each goes to the least loaded shard, through a heap. The schedule needs only how many groups there
are of each size class (1,024 classes per doubling, exact below 2,048 bytes), so the driver holds at most some 50,000 class rows, whatever the
table. In a class the heap hands out *numbers* of groups; which group gets which place follows from its rank in the class. Ranks, and the slots of
rows in a shard, come from counts per (class or shard, bucket), so no window holds a whole class or shard.

Defined cases: size is the bytes of the text plus 8, a null text has none and is one group with the empty texts; ties in
size go by the hash of the text, rows of a shard are numbered in hash buckets by id and then text hash; repeated rows get slots of their own;
an empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_dir

SHARDS = 24
STEPS = 10
#: Groups of a class beyond which the heap first gets whole rounds at once.
BULK = 4096


def _size_class(size: Column) -> Column:
    """Sizes below 2^(STEPS + 1) as they are, larger ones with their leading STEPS + 1 bits."""
    drop = F.greatest(F.length(F.bin(size)) - (STEPS + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def schedule(classes: list[tuple[int, int, float]], shards: int) -> list[tuple[int, list[int]]]:
    """Groups per shard for each (class, groups, mean size), largest class first."""
    heap = [(0.0, s) for s in range(shards)]
    plan = []
    for key, n, mean in sorted(classes, reverse=True):
        given, left = [0] * shards, n
        if left > BULK:
            # Level the loads at once as far as whole groups go; the heap gets the rest.
            loads = np.zeros(shards)
            for load, s in heap:
                loads[s] = load
            order = np.sort(loads)
            spent = np.arange(1, shards + 1) * order - np.cumsum(order)
            joined = int(np.searchsorted(spent, left * mean, side="right"))
            level = (left * mean + order[:joined].sum()) / joined
            bulk = np.maximum(0, np.floor((level - loads) / mean) - 1).astype(np.int64)
            given = bulk.tolist()
            left -= int(bulk.sum())
            heap = [(float(loads[s] + bulk[s] * mean), s) for s in range(shards)]
            heapq.heapify(heap)
        for _ in range(left):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + mean, s))
            given[s] += 1
        plan.append((key, given))
    return plan


def _ranked(df: DataFrame, keys: list[str], order: list[str], buckets: int, name: str) -> DataFrame:
    """Number rows of equal ``keys`` from 0: bucket after bucket, by ``order`` inside a bucket."""
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = spread.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = spread.withColumn("_place", F.row_number().over(inside) - 1)
    out = numbered.join(starts, [*keys, "_bucket"]).withColumn(name, (F.col("_start") + F.col("_place")).cast("bigint"))
    return out.drop("_bucket", "_n", "_start", "_place")


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row."""
    spark = docs.sparkSession
    shared_dir(spark)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("_text"),
    )
    groups = rows.groupBy("_text").agg(F.sum("size").alias("_bytes")).withColumn("_class", _size_class(F.col("_bytes")))
    groups = groups.checkpoint()
    classes = groups.groupBy("_class").agg(F.count("*").alias("n"), F.sum("_bytes").alias("bytes")).collect()
    plan = schedule([(c["_class"], c["n"], c["bytes"] / c["n"]) for c in classes], shards)
    bounds = [(key, np.cumsum(given)[:-1].tolist()) for key, given in plan]
    # One row per size class: bounded by the number of classes.
    table = F.broadcast(spark.createDataFrame(bounds, "_class bigint, _bounds array<bigint>"))
    placed = _ranked(groups, ["_class"], ["_text"], buckets, "_rank").join(table, "_class")
    placed = placed.select("_text", F.size(F.filter("_bounds", lambda b: b <= F.col("_rank"))).alias("shard"))
    out = rows.join(placed, "_text").checkpoint()
    return _ranked(out, ["shard"], ["doc_id", "_text"], buckets, "slot").drop("_text")
