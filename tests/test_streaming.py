import glob
import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from spanlake import schemas, sinks, sources, streaming
from spanlake.operators import access_log, capture, sanitize, sessions
from spanlake.session import scratch_path
from spanlake.sinks import snapshots
from test_access_log import COLUMNS, log
from test_spans import span, table


def add(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_ingest_and_restart(spark):
    source, lake, checkpoint = (scratch_path(spark, n) for n in ("src", "lake", "cp"))
    add(table(spark, *[span(i) for i in range(5)]), source)
    stream = streaming.stream_table(spark, source, schemas.SPAN, max_files=1)
    sink = streaming.start_span_sink(stream, lake, checkpoint)
    sink.awaitTermination()
    assert streaming.sink_stats(sink) == {"spans_added": 5, "micro_batches": 1}
    assert sources.read_spans(spark, lake).count() == 5
    add(table(spark, *[span(i, start=i + 1000) for i in range(5, 8)]), source)
    streaming.start_span_sink(stream, lake, checkpoint).awaitTermination()
    found = sources.read_spans(spark, lake, promoted=True)
    assert sorted(r["span_id"] for r in found.collect()) == [f"s{i:04d}" for i in range(8)]
    assert {r["shard"] for r in found.select("shard").collect()} == {"19700101_000000", "19700101_001500"}
    assert found.where("is_call and model = 'm'").count() == 8


def test_batch_sink(spark):
    """Seven rows in batches of two, in three runs, keeping six: the retained rows, and deletion on request."""
    for delete in (False, True):
        source, lake, checkpoint = (scratch_path(spark, n) for n in ("src", "lake", "cp"))
        for first, last in ((0, 3), (3, 4), (4, 11)):
            add(table(spark, *[span(i) for i in range(first, last)]), source)
            stream = streaming.stream_table(spark, source, schemas.SPAN, max_files=1)
            streaming.start_batch_sink(stream, lake, checkpoint, 2, 6, delete=delete).awaitTermination()
        kept = streaming.retained(spark, lake, 2, 6)
        got = sorted((r["span_id"], r["batch_idx"]) for r in kept.collect())
        assert got == [(f"s{i:04d}", i // 2) for i in range(4, 11)]
        folders = sorted(os.path.basename(p) for p in glob.glob(f"{lake}/batch_idx=*"))
        assert folders == [f"batch_idx={b}" for b in range(2 if delete else 0, 6)]
    assert streaming.expired([0, 1, 2, 3, 4], 2, 6) == [0]
    assert streaming.expired([], 2, 6) == []


def test_batch_sink_expired_at_once(spark, monkeypatch):
    """Batches that one micro-batch both fills and expires are never written, and a kept one has one file."""
    source, lake, gone = scratch_path(spark, "src"), scratch_path(spark, "lake"), []
    add(table(spark, *[span(i) for i in range(200)]), source)
    monkeypatch.setattr(snapshots, "delete", lambda spark, path: gone.append(path))
    stream = streaming.stream_table(spark, source, schemas.SPAN)
    streaming.start_batch_sink(stream, lake, scratch_path(spark, "cp"), 10, 20, delete=True).awaitTermination()
    assert gone == [] and len(glob.glob(f"{lake}/batch_idx=*/epoch=0/*.parquet")) == 3
    kept = sorted((r["span_id"], r["batch_idx"]) for r in streaming.retained(spark, lake, 10, 20).collect())
    assert kept == [(f"s{i:04d}", i // 10) for i in range(170, 200)]


def test_batch_sink_replay(spark):
    """A micro-batch that is written again replaces its own rows only."""
    source, lake = scratch_path(spark, "src"), scratch_path(spark, "lake")
    add(table(spark, *[span(i) for i in range(5)]), source)
    stream = streaming.stream_table(spark, source, schemas.SPAN)
    for _ in range(2):  # a lost checkpoint replays epoch 0
        streaming.start_batch_sink(stream, lake, scratch_path(spark, "cp"), 2, 100).awaitTermination()
    rows = sorted((r["span_id"], r["batch_idx"]) for r in sources.read_spans(spark, lake).collect())
    assert rows == [(f"s{i:04d}", i // 2) for i in range(5)]


def test_duplicates(spark):
    source, out = scratch_path(spark, "src"), scratch_path(spark, "out")
    for _ in range(3):
        add(table(spark, *[span(i, start=i + 10) for i in range(10)]), source)
    single = streaming.drop_duplicate_spans(streaming.stream_table(spark, source, schemas.SPAN, max_files=1))
    streaming.run(streaming.start_append_sink, single, out, scratch_path(spark, "cp"))
    assert sorted(r["span_id"] for r in spark.read.parquet(out).collect()) == [f"s{i:04d}" for i in range(10)]


def test_correlation(spark):
    source, out, waiting = (scratch_path(spark, n) for n in ("src", "out", "open"))
    at = "2024-01-01T00:00:{:02d}".format
    entries = [dict(type="request", request_id="a", timestamp=at(1), path="/x"), dict(type="request", request_id="b", timestamp=at(2), path="/y")]
    entries += [dict(type="response", request_id="a", timestamp=at(3)), dict(type="response", request_id="lost", timestamp=at(4))]
    entries += [dict(type="response", timestamp=at(5))] * 3
    add(log(spark, *entries), source)
    late = "2024-02-01T00:00:00"
    add(log(spark, dict(type="request", request_id="z", timestamp=late), dict(type="response", request_id="y", timestamp=late)), source)

    def sides():
        entries = streaming.stream_table(spark, source, COLUMNS)
        return access_log.filter_log(entries, "request"), access_log.filter_log(entries, "response")

    linked = streaming.correlate_stream(*sides()).select("request_id", "request_path", "duration_ms")
    streaming.run(streaming.start_append_sink, linked, out, scratch_path(spark, "cp"))
    found = sorted((tuple(r) for r in spark.read.parquet(out).collect() if r["request_id"] != "y"), key=str)
    assert found == sorted([("a", "/x", 2000.0), ("lost", None, None)] + [(None, None, None)] * 3, key=str)
    unanswered = streaming.open_requests_stream(*sides()).select("request_id")
    streaming.run(streaming.start_append_sink, unanswered, waiting, scratch_path(spark, "cp"))
    assert [r[0] for r in spark.read.parquet(waiting).collect() if r[0] != "z"] == ["b"]


def test_batch_transforms_on_streams(spark):
    """The same transform over a table and over a stream of it."""
    source = scratch_path(spark, "raw")
    kwargs = {"model": "gem-1", "messages": [{"role": "user", "content": "hi"}], "data": {"tools": [1], "n": 1}}
    response = {"choices": [{"message": {"content": "hello"}}], "usage": {"total_tokens": 3}}
    rows = [(f"c{i}", json.dumps(kwargs), json.dumps(response), None, float(i), i + 1.0) for i in range(20)]
    spark.createDataFrame(rows, schemas.RAW_CALL).write.json(source)
    models = spark.createDataFrame([("gem", ("openai/gemini", None, None))], "model_name STRING, litellm_params STRUCT<model: STRING, api_base: STRING, drop_params: BOOLEAN>")

    def spans(raw):
        return capture.build_spans(sanitize.sanitize_requests(raw, models))

    out = scratch_path(spark, "out")
    streamed = spans(sources.read_raw_calls(spark, source, streaming=True))
    streaming.run(streaming.start_append_sink, streamed, out, scratch_path(spark, "cp"))
    batch = spans(sources.read_raw_calls(spark, source))
    assert sorted(spark.read.parquet(out).collect()) == sorted(batch.collect())
    assert batch.where(F.col("status") == "OK").count() == 20


def test_log_stream(spark):
    source, out = scratch_path(spark, "log"), scratch_path(spark, "out")
    lines = [json.dumps({"type": t}) for t in ("request", "request", "error")] + ["", "broken"]
    spark.createDataFrame([(line,) for line in lines], "value STRING").write.text(source)
    good, _ = sources.split_log(sources.read_access_log(spark, source, streaming=True))
    counted = streaming.live_counts(good.withColumn("timestamp", F.lit("2024-01-01T00:00:00")), F.col("type"))
    streaming.start_upsert_sink(counted, out, scratch_path(spark, "cp"), ["window_start", "type"]).awaitTermination()
    kept = streaming.read_upserts(spark, out, ["window_start", "type"])
    assert {r["type"]: r["count"] for r in streaming.total_counts(kept, "type").collect()} == {"request": 2, "error": 1}


def state(query, k=0):
    """Rows in the state of an operator, and rows it dropped, per micro-batch."""
    told = [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]]
    return [o[k]["numRowsTotal"] for o in told], [o[k]["numRowsRemoved"] for o in told]


def test_state_stays_bounded(spark):
    """Ten micro-batches, each half a day after the one before: old windows leave the state, and their results stay."""
    source = scratch_path(spark, "src")
    for day in range(10):
        add(table(spark, *[span(100 * day + i, start=43200 * day + 600 * i) for i in range(70)]), source)
    stream = streaming.stream_table(spark, source, schemas.SPAN, max_files=1)
    for minutes, widest in ((30, 60), (7, 210)):
        out = scratch_path(spark, "out")
        query = streaming.start_upsert_sink(streaming.shard_counts(stream, minutes), out, scratch_path(spark, "cp"), ["shard"])
        query.awaitTermination()
        rows, removed = state(query)
        assert len(rows) >= 10 and sum(removed) > 0 and max(rows[1:]) <= widest
        kept = streaming.read_upserts(spark, out, ["shard"])
        assert kept.agg(F.sum("spans")).first()[0] == 700
        batch = sinks.with_shard(spark.read.parquet(source), minutes).groupBy("shard").count()
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, batch.collect()))


def test_live_log_state(spark):
    """Counters and sessions of a long log keep the windows of the last hours only."""
    source = scratch_path(spark, "log")
    entries = [[dict(type=t, request_id=f"{h}{t}", timestamp=f"2024-01-{1 + h // 24:02d}T{h % 24:02d}:00:00", path="/x", duration_ms=float(h)) for t in ("request", "response")] for h in range(0, 60, 4)]
    for some in entries:
        add(log(spark, *some), source)
    stream = streaming.stream_table(spark, source, COLUMNS, max_files=1)
    kept, summary = scratch_path(spark, "kept"), scratch_path(spark, "summary")
    query = streaming.start_upsert_sink(streaming.live_counts(stream, F.col("type")), kept, scratch_path(spark, "cp"), ["window_start", "type"])
    query.awaitTermination()
    rows, removed = state(query)
    assert sum(removed) >= 20 and max(rows) <= 6
    counts = streaming.total_counts(streaming.read_upserts(spark, kept, ["window_start", "type"]), "type")
    assert {r["type"]: r["count"] for r in counts.collect()} == {"request": 15, "response": 15}
    query = streaming.start_upsert_sink(streaming.live_summary(stream), summary, scratch_path(spark, "cp"), ["window_start"])
    query.awaitTermination()
    want = access_log.log_summary(spark.read.schema(COLUMNS).parquet(source)).first()
    assert streaming.total_summary(streaming.read_upserts(spark, summary, ["window_start"])).first() == want
    sessions_of = sessions.sessionize(stream.withColumn("ts", F.to_timestamp("timestamp")).withWatermark("ts", "1 hour"), "type", "ts")
    out = scratch_path(spark, "sessions")
    query = streaming.start_append_sink(sessions_of, out, scratch_path(spark, "cp"))
    query.awaitTermination()
    rows, removed = state(query)
    assert sum(removed) >= 20 and max(rows) <= 6 and spark.read.parquet(out).count() == sum(removed)


def test_reused_ids(spark):
    """A request is used up by the first response after it; replays do not count; state is dropped."""
    source = scratch_path(spark, "src")
    at = "2024-01-01T{:02d}:00:00".format
    asked = [dict(type="request", request_id="a", timestamp=at(h), path=f"/{h}") for h in (1, 2, 5, 9)]
    answered = [dict(type="response", request_id="a", timestamp=at(h)) for h in (3, 4, 5, 12)] + [dict(type="response", request_id=None, timestamp=at(6))]
    for entry in sorted(asked + answered, key=lambda e: e["timestamp"]) + [answered[0], asked[2]]:
        add(log(spark, entry), source)
    add(log(spark, dict(type="request", request_id="z", timestamp="2024-02-01T00:00:00"), dict(type="response", request_id="y", timestamp="2024-02-01T00:00:00")), source)
    add(log(spark, dict(type="request", request_id="z", timestamp="2024-03-01T00:00:00"), dict(type="response", request_id="y", timestamp="2024-03-01T00:00:00")), source)

    def sides():
        entries = streaming.stream_table(spark, source, COLUMNS, max_files=3)
        return access_log.filter_log(entries, "request"), access_log.filter_log(entries, "response")

    out, waiting = scratch_path(spark, "out"), scratch_path(spark, "open")
    linked = streaming.correlate_stream(*sides(), lateness="12 hours", max_wait="2 hours")
    query = streaming.start_append_sink(linked, out, scratch_path(spark, "cp"))
    query.awaitTermination()
    found = sorted(((r["timestamp"], r["request_path"], r["duration_ms"]) for r in spark.read.parquet(out).collect() if r["request_id"] != "y"), key=str)
    # The request of 9 h is more than the longest wait before the response of 12 h.
    assert found == [(at(3), "/2", 3600000.0), (at(4), None, None), (at(5), "/5", 0.0), (at(6), None, None), (at(12), None, None)]
    assert max(sum(o["numRowsRemoved"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]) > 0
    streaming.run(streaming.start_append_sink, streaming.open_requests_stream(*sides(), lateness="12 hours", max_wait="2 hours"), waiting, scratch_path(spark, "cp"))
    assert [(r["request_id"], r["timestamp"]) for r in spark.read.parquet(waiting).collect() if r["request_id"] != "z"] == [("a", at(9))]


def test_open_requests_of_a_busy_id(spark):
    """An id that comes back does not meet itself once per request: the join holds a few rows for each step of time."""
    source, out = scratch_path(spark, "src"), scratch_path(spark, "open")

    def at(second):
        return f"2024-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}"

    # Every 10 seconds for an hour, given twice; a response at the very time of the last one of id b; three requests without an id, two of them equal.
    entries = [dict(type="request", request_id=i, timestamp=at(10 * k), path=f"/{k}") for k in range(361) for i in "ab"] * 2
    entries += [dict(type="response", request_id="b", timestamp=at(3600))]
    entries += [dict(type="request", request_id=None, timestamp=at(50), path=p) for p in ("/n", "/n", "/m")]
    # The other one of the same time is left open as well.
    entries += [dict(type="request", request_id="a", timestamp=at(3600), path="/same"), dict(type="request", request_id="a", timestamp=at(3600 + 7201), path="/far")]
    add(log(spark, *entries), source)
    late = "2024-02-01T00:00:00"
    add(log(spark, dict(type="request", request_id="z", timestamp=late), dict(type="response", request_id="y", timestamp=late)), source)
    stream = streaming.stream_table(spark, source, COLUMNS)
    left = streaming.open_requests_stream(access_log.filter_log(stream, "request"), access_log.filter_log(stream, "response"))
    query = streaming.start_append_sink(left, out, scratch_path(spark, "cp"))
    query.awaitTermination()
    found = sorted((str(r["request_id"]), r["path"]) for r in spark.read.parquet(out).collect() if r["request_id"] != "z")
    assert found == [("None", "/m"), ("None", "/n"), ("a", "/360"), ("a", "/far"), ("a", "/same")]
    joins = [o for p in query.recentProgress for o in p["stateOperators"] if o["operatorName"] == "symmetricHashJoin"]
    assert 0 < sum(o["numRowsUpdated"] for o in joins) < 150


def test_links_of_a_busy_id(spark):
    """An id that comes back is put in order step by step, not joined with itself; the last event is found in the same step, in an earlier one, and in the span before."""
    source, out = scratch_path(spark, "src"), scratch_path(spark, "linked")

    def at(second):
        return f"2024-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}"

    # Id a every 9 seconds for four hours, b rarely, c with responses one wait, and a little more, after its requests.
    told = {("a", 9 * k, k * k % 7 > 2, "") for k in range(1600)} | {("b", 1700 * k, k % 3 == 1, "") for k in range(9)}
    told |= {("c", 100, False, ""), ("c", 7300, True, ""), ("c", 8000, False, ""), ("c", 15201, True, "")}
    # At one time: a request before the response, two requests, two responses that differ.
    told |= {("d", 30, False, ""), ("d", 30, True, ""), ("d", 50, False, "/x"), ("d", 50, False, "/y"), ("d", 60, True, "x"), ("d", 60, True, "y"), ("d", 61, True, "")}
    entries = [
        dict(type="response" if answer else "request", request_id=i, timestamp=at(second), path=None if answer else what or f"/{second}", body=what if answer else None)
        for i, second, answer, what in sorted(told)
    ]
    none = dict(type="response", request_id=None, timestamp=at(50))
    for some in (entries[::2], entries[1::2] + [none, none], entries[::5]):
        add(log(spark, *some), source)
    late = "2024-02-01T00:00:00"
    add(log(spark, dict(type="request", request_id="z", timestamp=late), dict(type="response", request_id="y", timestamp=late)), source)
    stream = streaming.stream_table(spark, source, COLUMNS)
    linked = streaming.correlate_stream(access_log.filter_log(stream, "request"), access_log.filter_log(stream, "response"))
    query = streaming.start_append_sink(linked, out, scratch_path(spark, "cp"))
    query.awaitTermination()
    want = [("None", at(50), "None", "None", "None")] * 2
    for i, second, answer, what in told:
        if answer:
            before = [e for e in told if e[0] == i and second - 7200 <= e[1] <= second and (e[1] < second or not e[2])]
            last = max(before, key=lambda e: (e[1], e[2], e[3]), default=None)
            path, elapsed = (None, None) if last is None or last[2] else (last[3] or f"/{last[1]}", 1000.0 * (second - last[1]))
            want.append((i, at(second), what, str(path), str(elapsed)))
    found = [tuple(str(r[c]) for c in ("request_id", "timestamp", "body", "request_path", "duration_ms")) for r in spark.read.parquet(out).collect() if r["request_id"] != "y"]
    assert sorted(found) == sorted(want)
    used = [o for p in query.recentProgress for o in p["stateOperators"]]
    assert used and all(o["operatorName"] != "symmetricHashJoin" for o in used)
    assert sum(o["numRowsUpdated"] for o in used) < 4 * len(told)


def test_lake_sink_of_many_shards(spark):
    """The files of a lake follow its bytes, not its shards; folders that no kept version names go; folders of the earlier layout are read and joined with new ones."""
    source, lake = scratch_path(spark, "src"), scratch_path(spark, "lake")
    old = sinks.with_promoted(sinks.with_shard(table(spark, *[span(200 + i, start=900 * i) for i in range(3)])))
    snapshots.append(old, lake, partition=["shard"])
    for first in (0, 40):
        add(table(spark, *[span(i, start=900 * i) for i in range(first, first + 40)]), source)
    stream = streaming.stream_table(spark, source, schemas.SPAN, max_files=1)
    streaming.start_lake_sink(stream, lake, scratch_path(spark, "cp"), 15, fan_in=3, keep_versions=1).awaitTermination()
    rows = {(r["span_id"], r["shard"]) for r in streaming.read_lake(spark, lake).collect()}
    assert len(rows) == 83 and len({s for _, s in rows}) == 80
    assert len(glob.glob(f"{lake}/data/part=*")) == 1 and len(glob.glob(f"{lake}/data/**/*.parquet", recursive=True)) <= 8


def test_lake_sink(spark):
    """A failure between write and commit leaves nothing to see; the files of a shard stay few; a lost checkpoint is a stream of its own."""
    source, lake, checkpoint = (scratch_path(spark, n) for n in ("src", "lake", "cp"))
    for i in range(9):
        add(table(spark, *[span(10 * i + k, start=k) for k in range(10)]), source)
    stream = streaming.stream_table(spark, source, schemas.SPAN, max_files=1)

    def fail(epoch):
        if epoch == 4:
            raise RuntimeError("between")

    with pytest.raises(StreamingQueryException):
        streaming.start_lake_sink(stream, lake, checkpoint, fan_in=3, failing=fail).awaitTermination()
    assert streaming.read_lake(spark, lake).count() == 40 and streaming.lake_stats(spark, lake)["spans_added"] == 40
    before = streaming.read_lake(spark, lake)
    streaming.start_lake_sink(stream, lake, checkpoint, fan_in=3).awaitTermination()
    found = streaming.read_lake(spark, lake)
    assert found.count() == found.select("span_id").distinct().count() == 90 and before.count() == 40
    assert len(found.inputFiles()) <= 4 and found.where("is_call AND shard = '19700101_000000'").count() == 90
    assert streaming.lake_stats(spark, lake) == {"spans_added": 90, "spans_flushed": 90, "micro_batches": 9, "folders": 1, "current_shard": "19700101_000000"}
    streaming.start_lake_sink(stream, lake, scratch_path(spark, "cp"), fan_in=3).awaitTermination()
    assert streaming.lake_stats(spark, lake)["spans_added"] == 180


def test_quarantine_in_one_query(spark):
    """Broken lines go to a table of their own; a crash between the two commits doubles nothing."""
    source, good, bad, checkpoint = (scratch_path(spark, n) for n in ("log", "good", "bad", "cp"))
    lines = [json.dumps({"type": t, "request_id": str(i)}) for i, t in enumerate(("request", "response", "error"))] + ["", "  ", "{oops", '{"type": 5', "[1]"]
    for some in (lines[:4], lines[4:]):
        spark.createDataFrame([(line,) for line in some], "value STRING").coalesce(1).write.mode("append").text(source)
    entries = sources.read_access_log(spark, source, streaming=True)
    append, calls = snapshots.append, []

    def crash(rows, path, *args):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("between the commits")
        return append(rows, path, *args)

    snapshots.append = crash
    try:
        with pytest.raises(StreamingQueryException):
            streaming.start_split_sink(entries, good, bad, checkpoint).awaitTermination()
    finally:
        snapshots.append = append
    streaming.start_split_sink(entries, good, bad, checkpoint).awaitTermination()
    assert sorted(r["type"] for r in snapshots.read(spark, good).collect() if r["type"]) == ["error", "request", "response"]
    broken = sorted(r[0] for r in snapshots.read(spark, bad).collect())
    want = sources.split_log(sources.read_access_log(spark, source))[1]
    assert broken == sorted(r[0] for r in want.collect()) and {"{oops", '{"type": 5'} <= set(broken)
    raw = scratch_path(spark, "raw")
    spark.createDataFrame([('{"call_id": "a", "kwargs": "{}"}',), ("{no",)], "value STRING").write.text(raw)
    readable, rest = sources.split_log(sources.read_raw_calls(spark, raw, keep_broken=True))
    assert [r["call_id"] for r in readable.collect()] == ["a"] and [r[0] for r in rest.collect()] == ["{no"]
