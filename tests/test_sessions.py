import random

from pyspark.sql import functions as F

from spanlake.operators import sessions


def test_gap(spark):
    rows = [("u", 0.0), ("u", 1800.0), ("u", 3600.5), ("u", 5400.6), ("v", 10.0), ("w", 1799.0), ("w", 1801.0)]
    df = spark.createDataFrame(rows, "k STRING, at DOUBLE")
    got = sorted((r["k"], r["session_start"], r["last_seen"], r["turns"]) for r in sessions.session_metrics(df, "k", "at", 1800).collect())
    assert got == [("u", 0.0, 1800.0, 2), ("u", 3600.5, 3600.5, 1), ("u", 5400.6, 5400.6, 1), ("v", 10.0, 10.0, 1), ("w", 1799.0, 1801.0, 2)]


def test_both_forms_agree(spark):
    random.seed(5)
    rows = [(random.choice("abbbbb"), random.randint(0, 60) * 300) for _ in range(300)]
    df = spark.createDataFrame(rows, "k STRING, at LONG").withColumn("ts", F.timestamp_seconds("at"))
    fast = sessions.session_metrics(df, "k", "at", 900)
    slow = sessions.sessionize(df, "k", "ts", "15 minutes")
    left = sorted((r["k"], r["session_start"], r["session_end"], r["turns"]) for r in fast.collect())
    right = sorted(
        (r["k"], r["a"], r["b"], r["turns"])
        for r in slow.withColumns({"a": F.unix_seconds("session_start").cast("double"), "b": F.unix_seconds("session_end").cast("double")}).collect()
    )
    assert left == right


def check_tree(spark):
    chain = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(70)]
    star = [(f"leaf{i}", "c3") for i in range(50)]
    others = [("orphan", "missing"), ("x", "y"), ("y", "x"), ("below", "x"), ("self", "self"), ("root", None), ("c5", "c4")]
    df = spark.createDataFrame(chain + star + others, "span_id STRING, parent_id STRING")
    got = {r["span_id"]: (r["root_id"], r["depth"]) for r in sessions.span_children(df).collect()}
    want = {f"c{i}": ("c0", i) for i in range(70)} | {f"leaf{i}": ("c0", 4) for i in range(50)}
    want |= {"orphan": ("orphan", 0), "root": ("root", 0)} | {k: (None, None) for k in ("x", "y", "below", "self")}
    assert got == want


def test_tree(spark):
    check_tree(spark)


def test_tree_with_heavy_parents(spark, heavy):
    check_tree(spark)


def test_percentiles_from_sketches(spark):
    """Sketches of hours give the percentiles of a day within their bound, and exactly for few values."""
    df = spark.range(48_000).select(F.timestamp_seconds(F.col("id") % 86_400).alias("ts"), (F.col("id") * 7919 % 48_000).cast("double").alias("ms"), (F.col("id") % 2).alias("k"))
    hours = sessions.latency_sketches(df, "ts", "1 hour", "ms", ["k"])
    assert hours.count() == 28 and hours.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    for r in sessions.latency_percentiles(hours, "day", keys=["k"]).collect():
        assert r["requests"] == 24_000 and all(abs(r[f"p{p}"] - 480 * p) < 960 for p in (50, 95, 99))
    few = df.where("ms < 100")
    found = sessions.latency_percentiles(sessions.latency_sketches(few, "ts", "1 hour", "ms"), "day", (0.5, 1.0)).first()
    assert (found["requests"], found["p50"], found["p100"]) == (100, 49.0, 99.0)
