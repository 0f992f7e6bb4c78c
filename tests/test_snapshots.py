import threading

import pytest
from pyspark.sql import functions as F

from spanlake.session import scratch_path
from spanlake.sinks import snapshots


def numbers(spark, low, high):
    return spark.range(low, high).withColumn("shard", F.col("id") % 3)


def same(df):
    return df


def test_versions_and_compaction(spark):
    path = scratch_path(spark, "snap")
    assert snapshots.snapshot(spark, path).version == -1
    assert snapshots.read(spark, path, schema="id bigint").count() == 0
    with pytest.raises(ValueError):
        snapshots.read(spark, path)
    for i in range(9):
        snapshots.append(numbers(spark, 10 * i, 10 * i + 10), path, partition=["shard"])
    assert snapshots.append(numbers(spark, 0, 0), path).version == 9 and len(snapshots.snapshot(spark, path).folders) == 9
    before = snapshots.read(spark, path)
    done = snapshots.compact(spark, path, same, ["shard"], fan_in=4)
    # Nine folders of level 0 become one of level 1; a reader that began before sees what it saw.
    assert [(f.level, f.rows) for f in done.folders] == [(1, 90)]
    assert before.count() == 90 and snapshots.read(spark, path).agg(F.sum("id")).first()[0] == sum(range(90))
    assert snapshots.read(spark, path, version=2).count() == 30
    assert len(snapshots.vacuum(spark, path, 1)) == 9 and snapshots.vacuum(spark, path, 1) == []
    assert snapshots.versions(spark, path) == [done.version] and snapshots.read(spark, path).count() == 90


def test_levels_bound_the_folders(spark):
    path = scratch_path(spark, "snap")
    for i in range(30):
        snapshots.append(spark.range(i, i + 1), path)
        snapshots.compact(spark, path, same, fan_in=3)
        assert len(snapshots.snapshot(spark, path).folders) <= 8
    assert sorted(r[0] for r in snapshots.read(spark, path).collect()) == list(range(30))
    assert {f.level for f in snapshots.snapshot(spark, path).folders} == {3, 1}


def test_writers_at_once(spark):
    """Every commit of several writers and a compaction stays."""
    path = scratch_path(spark, "snap")
    jobs = [threading.Thread(target=lambda i=i: snapshots.append(spark.range(5 * i, 5 * i + 5), path)) for i in range(8)]
    jobs.append(threading.Thread(target=lambda: snapshots.compact(spark, path, same, fan_in=2)))
    for job in jobs:
        job.start()
    for job in jobs:
        job.join()
    assert sorted(r[0] for r in snapshots.read(spark, path).collect()) == list(range(40))


def test_one_writer_wins(spark):
    """Of eight writers that put down one file at once, one wins, and the file is that one's."""
    for n in range(40):
        path, won, ready = f"{scratch_path(spark, 'made')}/{n}.json", [], threading.Barrier(8)

        def write(i):
            ready.wait()
            if snapshots._create(spark, path, str(i) * 600):
                won.append(i)

        jobs = [threading.Thread(target=write, args=(i,)) for i in range(8)]
        for job in jobs:
            job.start()
        for job in jobs:
            job.join()
        assert len(won) == 1 and spark.read.text(path).first()[0] == str(won[0]) * 600


def test_compaction_that_lost(spark):
    """A compaction whose folders another one took commits nothing."""
    path = scratch_path(spark, "snap")
    for i in range(4):
        snapshots.append(spark.range(i, i + 1), path)

    def slow(df):
        if not raced:
            raced.append(True)
            snapshots.compact(spark, path, same, fan_in=4)
        return df

    raced = []
    snapshots.compact(spark, path, slow, fan_in=4)
    assert [(f.level, f.rows) for f in snapshots.snapshot(spark, path).folders] == [(1, 4)]
    assert snapshots.read(spark, path).count() == 4


def test_replayed_micro_batch(spark):
    path = scratch_path(spark, "snap")

    def crash(epoch):
        raise RuntimeError("lost")

    snapshots.append(spark.range(3), path, "q", 0)
    with pytest.raises(RuntimeError):
        snapshots.append(spark.range(3, 5), path, "q", 1, failing=crash)
    assert snapshots.read(spark, path).count() == 3
    for _ in range(2):
        snapshots.append(spark.range(3, 5), path, "q", 1)
    assert snapshots.read(spark, path).count() == 5
    assert snapshots.snapshot(spark, path).streams == {"q": {"epoch": 1, "rows": 5, "micro_batches": 2}}


def test_upserts(spark):
    path = scratch_path(spark, "snap")
    for epoch in range(12):
        rows = spark.createDataFrame([("a", None, epoch), ("b" if epoch < 3 else "c", "x", epoch)], "k string, l string, n int")
        snapshots.upsert(rows, path, ["k", "l"], "q", epoch, fan_in=3, keep_versions=2)
    found = snapshots.read_upserts(spark, path, ["k", "l"])
    assert sorted(map(tuple, found.collect())) == [("a", None, 11), ("b", "x", 2), ("c", "x", 11)]
    assert sum(f.rows for f in snapshots.snapshot(spark, path).folders) <= 8 and len(snapshots.versions(spark, path)) == 2
