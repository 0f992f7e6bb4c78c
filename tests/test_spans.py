import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanlake import schemas, sinks, sources
from spanlake.operators import spans as ops, store
from spanlake.plans import exports
from spanlake.session import scratch_path

NAMES = [c.split(" ")[0] for c in schemas.SPAN.split(", ")]


def span(i, rollout="A", attempt="a", start=None, **more):
    row = dict(
        name="llm.completion", trace_id="t", span_id=f"s{i:04d}", parent_id=None, start_time=float(i if start is None else start),
        end_time=None, kind="CLIENT", status="OK", attributes=json.dumps({"llm.request.messages": "[]", "llm.model": "m"}),
        rollout_id=rollout, attempt_id=attempt, sequence_id=0, resource_attributes="{}",
    )
    return row | more


def table(spark, *rows):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], schemas.SPAN)


def ids(df):
    return [r["span_id"] for r in df.collect()]


def test_query(spark):
    spans = table(spark, span(1, "A"), span(2, "A", "b"), span(3, "B"), *[span(i, "C") for i in range(10, 20)])
    assert ids(ops.query_spans(spans, "A")) == ["s0001", "s0002"]
    assert ids(ops.query_spans(spans, "A", "b")) == ["s0002"]
    assert ids(ops.query_spans(spans, attempt_id="b")) == ["s0002"]
    assert ids(ops.query_spans(spans, limit=5)) == ["s0001", "s0002", "s0003", "s0010", "s0011"]
    assert ids(ops.query_spans(spans.limit(0))) == []


def test_calls_and_views(spark):
    mention = json.dumps({"note": "llm.request.messages"})
    spans = table(spark, span(1), span(2, attributes=mention), span(3, attributes="broken"), span(4, end_time=4.25))
    assert sorted(ids(ops.llm_calls(spans))) == ["s0001", "s0004"]
    assert ids(ops.latest(spans, 1)) == ["s0004"] and ids(ops.earliest(spans, 1)) == ["s0001"]
    view = {r["span_id"]: r for r in ops.call_view(spans).collect()}
    assert view["s0004"]["duration_ms"] == 250 and view["s0001"]["duration_ms"] is None
    assert view["s0001"]["response"] == "(empty response)" and view["s0001"]["time"] == "1970-01-01 00:00:01"
    assert view["s0001"]["total_tokens"] is None
    assert ops.with_duration(spans).where("duration is null").count() == 3


def test_validation(spark):
    good = [span(1), span(2, kind=None, status=None), span(3, attributes=None)]
    bad = [span(4, kind="ROBOT"), span(5, status="DONE"), span(6, attributes="[1]"), span(7, name=None), span(8, start=None, start_time=None)]
    fine, broken = ops.validate_spans(table(spark, *good, *bad))
    assert sorted(ids(fine)) == ["s0001", "s0002", "s0003"]
    assert fine.count() + broken.count() == len(good + bad)


def test_nested_round_trip(spark):
    attributes = json.dumps({"a": 1, "b": [1, 2], "c": "x", "d": 0.5, "e": True, "n": None})
    flat = table(spark, span(1, attributes=attributes))
    back = ops.flatten_span(ops.nest_span(flat)).first()
    assert json.loads(back["attributes"]) == json.loads(attributes)
    assert {n: back[n] for n in NAMES if n != "attributes"} == {n: flat.first()[n] for n in NAMES if n != "attributes"}
    nested = ops.nest_span(table(spark, span(1, kind=None, status=None, attributes=None, resource_attributes=None, sequence_id=None))).first()
    assert (nested["kind"], nested["status"], nested["attributes"], nested["sequence_id"], nested["events"]) == ("INTERNAL", "UNSET", {}, 0, [])


@pytest.mark.parametrize("threshold", [None, "10"])
def test_sequence(spark, threshold):
    rows = [span(i, "hot", start=i // 7) for i in range(300)] + [span(1000 + i, f"r{i % 9}", start=-i) for i in range(60)]
    spans = table(spark, *rows)
    if threshold:
        spark.conf.set("spanlake.skew.heavyRows", threshold)
    try:
        got = {r["span_id"]: r["sequence_id"] for r in ops.with_sequence(spans).collect()}
    finally:
        spark.conf.unset("spanlake.skew.heavyRows")
    frame = pd.DataFrame(rows).sort_values(["start_time", "span_id"])
    want = dict(zip(frame["span_id"], frame.groupby(["rollout_id", "attempt_id"]).cumcount()))
    assert got == want


def test_lake(spark):
    path = scratch_path(spark, "lake")
    day = 1704067200
    sinks.write_spans(table(spark, span(1, start=day), span(2, start=day + 400)), path, 5)
    sinks.write_spans(table(spark, span(3, start=day + 10)), path, 5)
    spans = sources.read_spans(spark, path)
    assert sorted((r["span_id"], r["shard"]) for r in spans.collect()) == [
        ("s0001", "20240101_000000"), ("s0002", "20240101_000500"), ("s0003", "20240101_000000")]
    stats = store.store_stats(spans).first()
    assert (stats["spans"], stats["files"], stats["current_shard"]) == (3, 3, "20240101_000500")
    merged = scratch_path(spark, "merged")
    sinks.merge_spans(spans, merged, target_files=1)
    assert store.dataset_stats(spark, merged).first()["files"] == 1
    assert sorted(ids(sources.read_spans(spark, merged))) == ["s0001", "s0002", "s0003"]
    assert ids(sources.head(sources.read_spans(spark, merged), 2)) == ids(sources.read_spans(spark, merged))[:2]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pushdown(spark):
    path = scratch_path(spark, "lake")
    sinks.write_spans(table(spark, *[span(i, f"r{i % 5}") for i in range(50)]), path, 5)
    spans = sources.read_spans(spark, path, promoted=True)
    lookup = plan(ops.query_spans(spans, "r1"))
    assert "EqualTo(rollout_id,r1)" in lookup and "TakeOrderedAndProject" in lookup
    totals = plan(ops.token_totals(spans, ["model"]))
    assert "attributes" not in totals.split("ReadSchema")[1].split("\n")[0]
    sft = plan(exports.spans_to_sft(spans))
    for pushed in ("EqualTo(status,OK)", "EqualTo(is_call,true)", "EqualTo(has_response,true)"):
        assert pushed in sft
    newest = plan(ops.latest(spans, 3))
    assert "GreaterThanOrEqual(start_time,47.0)" in newest
    pruned = plan(spans.where("shard = '19700101_000000'").groupBy("name").count())
    assert "PartitionFilters: [isnotnull(shard" in pruned


def test_first_by_time_on_a_lake(spark):
    """The two-step form against the plain one: ties at the edge, missing times, fewer rows than asked for."""
    rows = [span(i, "A" if i % 2 else "B", start=i // 6) for i in range(60)] + [span(99, start=None, start_time=None)]
    plain = table(spark, *rows)
    lake = sinks.with_promoted(plain)
    for n in (0, 1, 7, 60, 61, 100):
        assert ids(ops.latest(lake, n)) == ids(ops.latest(plain, n))
        assert ids(ops.earliest(lake, n)) == ids(ops.earliest(plain, n))
        assert ids(ops.query_spans(lake, "A", limit=n)) == ids(ops.query_spans(plain, "A", limit=n))
    assert ids(ops.latest(lake, 2)) == ["s0054", "s0055"]


def test_foreign_files(spark, tmp_path):
    """Files of another writer: an untyped null column, a missing column, a broken file, sub-folders."""
    folder = tmp_path / "spans"
    (folder / "0").mkdir(parents=True)
    pd.DataFrame([span(1)]).to_parquet(folder / "spans_20240101_000000.parquet")
    pd.DataFrame([span(2, parent_id="s0001")]).drop(columns="end_time").to_parquet(folder / "0" / "spans_20240101_000500.parquet")
    target = scratch_path(spark, "imported")
    rows = {r["span_id"]: r for r in sources.import_foreign(spark, str(folder), target).collect()}
    assert rows["s0001"]["parent_id"] is None and rows["s0002"]["parent_id"] == "s0001" and rows["s0002"]["end_time"] is None
    (folder / "spans_20240101_001000.parquet").write_bytes(b"not parquet at all")
    again = sources.import_foreign(spark, str(folder), scratch_path(spark, "imported"))
    assert sorted(ids(again)) == ["s0001", "s0002"]
    numbered = scratch_path(spark, "imported")
    sources.import_foreign(spark, str(folder), numbered, batches=True)
    assert ids(sources.read_batches(spark, numbered, [0])) == ["s0002"]
    with pytest.raises(Exception):
        sources.import_foreign(spark, str(folder), scratch_path(spark, "imported"), skip_unreadable=False)
    stats = {r["file_name"]: (r["rows"], r["state"]) for r in store.file_stats(spark, str(folder)).collect()}
    assert stats == {
        "spans_20240101_000000.parquet": (1, "ok"),
        "spans_20240101_000500.parquet": (1, "ok"),
        "spans_20240101_001000.parquet": (0, "empty_or_unreadable"),
    }
    assert store.dataset_stats(spark, str(folder)).first()["rows"] == 2
    samples = store.file_samples(sources.read_spans(spark, target), columns=3).first()
    assert samples["columns"].startswith("name, trace_id") and samples["name"] == "llm.completion"


def test_latest_shard(spark):
    path = scratch_path(spark, "latest")
    for i in range(3):
        table(spark, span(i)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    assert ids(sources.latest_shard(spark, path)) == ["s0002"]


def test_models(spark, tmp_path):
    entry = {"model_name": "a", "litellm_params": {"model": "openai/a", "drop_params": True}}
    for name in ("model_list", "models"):
        file = tmp_path / f"{name}.json"
        file.write_text(json.dumps({name: [entry], "other": 1}, indent=2))
        (row,) = sources.read_model_config(spark, str(file)).collect()
        assert (row["model_name"], row["litellm_params"]["model"], row["litellm_params"]["drop_params"]) == ("a", "openai/a", True)


def test_preview_and_union(spark):
    spans = table(spark, span(1, attributes="x" * 300))
    assert len(store.preview(spans, 1).first()["attributes"]) == 100
    both = ops.union_spans(spans, spans.drop("end_time").withColumn("extra", F.lit(1)))
    assert both.count() == 2 and "extra" in both.columns


def test_one_listing_of_few_tasks(spark, monkeypatch):
    """The files of a lake are listed once, by a number of tasks that follows the cores; other columns of the files are left out."""
    path, key = scratch_path(spark, "lake"), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    lake = sinks.with_promoted(sinks.with_shard(table(spark, *[span(i, start=900 * i) for i in range(40)])))
    lake.write.partitionBy("shard").parquet(path)
    listed, before = [], spark.conf.get(key)
    reader = type(spark.read)
    plain = reader.parquet
    monkeypatch.setattr(reader, "parquet", lambda self, *paths, **more: listed.append(int(spark.conf.get(key))) or plain(self, *paths, **more))
    found = sources.read_spans(spark, path, promoted=True)
    assert listed == [min(int(before), 4 * spark.sparkContext.defaultParallelism)] and spark.conf.get(key) == before
    assert found.columns == [*NAMES, *schemas.PROMOTED_NAMES, "shard"] and found.count() == 40
    wider = scratch_path(spark, "wider")
    lake.withColumn("more", F.lit(1)).write.partitionBy("shard").parquet(wider)
    assert sources.read_spans(spark, wider, promoted=True).columns == found.columns


def test_small_bloom_filters(spark):
    """The files of a small shard are small."""
    path = scratch_path(spark, "lake")
    sinks.write_spans(table(spark, *[span(i, f"r{i}") for i in range(40)]), path, 60)
    assert store.file_stats(spark, path).agg(F.max("bytes")).first()[0] < 16_000


def test_bloom_filters_skip_row_groups(spark):
    """An id that is not there, but between the smallest and the largest of each file, reads no row."""


    path = scratch_path(spark, "lake")
    sinks.write_spans(table(spark, *[span(2 * i, f"r{2 * i:05d}", start=900 * (i % 4)) for i in range(2000)]), path)
    lake = sources.read_spans(spark, path)

    def read(condition):
        found = lake.where(condition)
        rows = found.count(), found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        return len(rows[1]), plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    assert read("span_id = 's1001'") == (0, 0) and read("rollout_id = 'r01001'") == (0, 0)
    found, touched = read("span_id = 's1000'")
    assert found == 1 and touched < 2000


def test_variant_attributes(spark):
    """Typed attributes, lists and odd texts from the shredded column, without any parse of the text."""
    from spanlake.functions import variant_attr

    path = scratch_path(spark, "lake")
    texts = [json.dumps({"llm.model": f"m{i % 3}", "n": i, "tags": ["a", f"b{i}"], "it's": True, "nested": {"k": [1, 2]}}) for i in range(60)]
    texts += [json.dumps({"llm.model": 5, "n": "x", "tags": "none"}), "{oops", "[1]", None, "{}"]
    sinks.write_spans(table(spark, *[span(i, attributes=t) for i, t in enumerate(texts)]), path, variant=True)
    lake = sources.read_spans(spark, path, variant=True)
    attrs = F.col("attrs")
    found = lake.select(
        "span_id",
        variant_attr(attrs, "llm.model").alias("model"),
        variant_attr(attrs, "n", "bigint").alias("n"),
        variant_attr(attrs, "tags", "array<string>").alias("tags"),
        variant_attr(attrs, "it's", "boolean").alias("its"),
        variant_attr(attrs, "nested", "struct<k: array<int>>").alias("nested"),
    )
    rows = {r["span_id"]: tuple(r)[1:] for r in found.collect()}
    assert len(rows) == 65 and rows["s0007"] == ("m1", 7, ["a", "b7"], True, ([1, 2],))
    assert rows["s0060"] == ("5", None, None, None, None)
    assert all(rows[f"s{i:04d}"] == (None,) * 5 for i in range(61, 65))
    narrow = found.where("n = 7")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert narrow.count() == 1 and "get_json_object" not in plan and "from_json" not in plan and "attributes#" not in plan
    totals = ops.token_totals(lake, ["model"])
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert totals.count() >= 3 and "from_json" not in plan and "attributes#" not in plan
