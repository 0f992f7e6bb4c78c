import json

from spanlake import schemas, sinks, sources
from spanlake.operators import access_log as ops
from spanlake.session import scratch_path

COLUMNS = schemas.LOG.replace(", _corrupt_record STRING", "")
NAMES = [c.split(" ")[0] for c in COLUMNS.replace("MAP<STRING, STRING>", "MAP").split(", ")]


def log(spark, *entries):
    return spark.createDataFrame([tuple(e.get(n) for n in NAMES) for e in entries], COLUMNS)


ENTRIES = [
    dict(type="request", request_id="a", timestamp="2024-01-01T00:00:00", method="POST", path="/x", body="b" * 250),
    dict(type="request", request_id="b", timestamp="2024-01-01T00:00:01", method="GET", path="/y"),
    dict(type="request", request_id="c", timestamp="2024-01-01T00:00:02"),
    dict(type="response", request_id="a", timestamp="2024-01-01T00:00:03.5", status_code=200, duration_ms=3500.0),
    dict(type="response", request_id="lost", timestamp="2024-01-01T00:00:04", status_code=500, error="late", request_path="/z"),
    dict(type="response", request_id=None, timestamp="2024-01-01T00:00:04", status_code=200, error=""),
    dict(type="error", timestamp="2024-01-01T00:00:05", method="GET", path="/x", error="down"),
]


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_counts(spark):
    entries = log(spark, *ENTRIES)
    assert dict(pairs(ops.count_by_type(entries))) == {"request": 3, "response": 3, "error": 1}
    assert dict(pairs(ops.count_by_status(entries))) == {200: 2, 500: 1}
    assert pairs(ops.top_paths(entries, 2)) == [("/x", 1), ("/y", 1)]  # ties in key order
    assert pairs(ops.top_paths(entries))[2] == ("unknown", 1)
    assert pairs(ops.count_errors(entries)) == [(2,)]
    assert pairs(ops.top_error_paths(entries)) == [("/x", 1), ("unknown", 1)]
    assert pairs(ops.top_error_paths(entries, use_request_path=True)) == [("/x", 1), ("/z", 1)]
    assert pairs(ops.duration_stats(entries)) == [(3500.0, 3500.0, 3500.0)]
    assert ops.filter_log(entries, "response", 500).count() == 1


def test_empty_log(spark):
    none = log(spark)
    assert pairs(ops.duration_stats(none)) == [(0.0, None, None)]
    assert pairs(ops.time_range(none)) == [("N/A", "N/A")]
    assert ops.log_summary(none).first()["entries"] == 0


def test_details(spark):
    rows = {r["entry"] + str(r["request_id"]): r for r in ops.log_detail_view(log(spark, *ENTRIES)).collect()}
    assert rows["REQUESTa"]["body"] == "b" * 200 + "..."
    assert rows["REQUESTc"]["method"] == "N/A" and rows["REQUESTc"]["status"] is None
    assert rows["RESPONSEa"]["duration"] == "3500.0 ms" and rows["RESPONSElost"]["duration"] == "N/A ms"
    assert rows["RESPONSEN/A"]["error"] is None
    assert rows["ERRORN/A"]["error"] == "down" and rows["ERRORN/A"]["path"] == "/x"


def check_links(spark):
    entries = log(spark, *ENTRIES, *[dict(type="response", timestamp="2024-01-01T00:00:09", status_code=1)] * 40,
                  *[dict(type="request", request_id="a", timestamp="2023-12-31T00:00:00", method="OLD")] * 15,
                  *[dict(type="response", request_id="b", timestamp="2024-01-01T00:00:02")] * 30)
    requests, responses = ops.filter_log(entries, "request"), ops.filter_log(entries, "response")
    linked = ops.correlate_log(requests, responses)
    assert linked.count() == responses.count()
    found = {(r["request_id"], r["request_method"], r["request_path"], r["duration_ms"]) for r in linked.collect()}
    assert found == {("a", "POST", "/x", 3500.0), ("lost", None, None, None), (None, None, None, None), ("b", "GET", "/y", 1000.0)}
    assert pairs(ops.open_requests(requests, responses).select("request_id")) == [("c",)]


def test_links(spark):
    check_links(spark)


def test_reused_ids(spark):
    """The last request before a response counts, and only the first response after it; slices of an hour do not matter."""
    told = [("request", "10:00:00", "/a"), ("response", "10:01:00", None), ("request", "10:05:00", "/b"), ("request", "13:00:00", "/c"),
            ("response", "15:00:00", None), ("response", "15:00:30", None), ("request", "18:00:00", "/d")]
    entries = log(spark, *[dict(type=k, request_id="x", timestamp=f"2024-01-01T{t}", path=p, method=None) for k, t, p in told])
    requests, responses = ops.filter_log(entries, "request"), ops.filter_log(entries, "response")
    linked = {r["timestamp"][11:]: (r["request_path"], r["duration_ms"]) for r in ops.correlate_log(requests, responses).collect()}
    assert linked == {"10:01:00": ("/a", 60_000.0), "15:00:00": ("/c", 7_200_000.0), "15:00:30": (None, None)}
    assert pairs(ops.open_requests(requests, responses).select("path")) == [("/d",)]


def test_links_with_heavy_keys(spark, heavy):
    check_links(spark)


def test_log_files(spark):
    path = scratch_path(spark, "log")
    lines = [json.dumps(dict(type="request", request_id="ü", headers={"h": "1"})), "", "  ", "no json", '{"type": "error"', '{"status_code": "x"}']
    spark.createDataFrame([(line,) for line in lines], "value STRING").coalesce(1).write.text(path)
    good, bad = sources.split_log(sources.read_access_log(spark, path))
    assert pairs(good.select("type", "request_id", "headers")) == [("request", "ü", {"h": "1"})]
    assert bad.count() == 3
    assert sorted(r[0] for r in bad.collect()) == sorted(lines[3:])
    again = scratch_path(spark, "log")
    sinks.write_access_log(good, again)
    assert "ü" in spark.read.text(again).first()[0]
