import json
import math

import pytest
from pyspark.sql import functions as F

from spanlake import schemas
from spanlake.operators import joins, turns
from spanlake.plans import exports
from spanlake.session import scratch_path
from test_spans import span, table


def conversation(conv, n):
    roles = ["system"] + ["user", "assistant"] * n
    return [(conv, i, r, f"{r} {conv} {i}" + "x" * (i % 5)) for i, r in enumerate(roles)][: n]


TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def test_long_conversations(spark):
    """Parts of 5 turns against whole conversations: same calls, and histories that add up."""
    rows = conversation(1, 23) + conversation(2, 4) + [(3, i, "assistant", f"t{i}") for i in range(12)]
    told = spark.createDataFrame(rows, TURNS)
    whole = {(r["conv_id"], r["turn"]): r for r in turns.calls_from_turns(told).collect()}
    parts = {(r["conv_id"], r["turn"]): r for r in turns.calls_from_turns(told, part_turns=5).collect()}
    assert whole.keys() == parts.keys() and len(whole) > 10
    same = ("sequence_id", "system", "last_user", "response", "prompt_tokens", "completion_tokens", "total_tokens", "start_time", "messages")
    for key, row in whole.items():
        assert [row[c] for c in same] == [parts[key][c] for c in same]
    rebuilt = {(r["conv_id"], r["part"]): r["turns"] for r in turns.rebuild_conversation(told, 5).collect()}
    assert all(len(t) <= 5 for t in rebuilt.values())
    for r in turns.with_history(told, 5).collect():
        assert [(t["turn"], t["role"], t["text"]) for t in r["history"]] == [x[1:] for x in rows if x[0] == r["conv_id"] and x[1] < r["turn"]]
    messages = turns.multi_turn_sft(told).where("conv_id = 2").first()["messages"]
    assert [(m["role"], m["content"]) for m in messages] == [x[2:] for x in conversation(2, 4)]


def test_complete_examples(spark):
    """Each part begins with its conversation, and the last one is all of it, at any size of parts."""
    rows = conversation(1, 23) + conversation(2, 4) + [(3, i, "user", None if i % 4 else f"t{i}") for i in range(12)]
    told = spark.createDataFrame(rows, TURNS)
    for size in (1, 5, 7, 1024):
        found = turns.multi_turn_sft(told, size).collect()
        assert sum(r["n_turns"] for r in found) == len(rows)
        for r in found:
            own = [x[2:] for x in rows if x[0] == r["conv_id"]]
            assert [(m["role"], m["content"]) for m in r["messages"]] == own[: r["part"] * size + r["n_turns"]]
    # The conversation that holds most turns is built by more than one task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = turns.multi_turn_sft(spark.createDataFrame(conversation(9, 200), TURNS), 5)
        assert len({r[0] for r in hot.select(F.spark_partition_id()).collect()}) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copied_turns(spark, heavy):
    """A conversation of which one turn is there 40 times is cut into bounded parts, and keeps every row."""
    rows = conversation(1, 6) + [(2, 0, "user", "again")] * 40 + conversation(2, 3)[1:]
    told = spark.createDataFrame(rows, TURNS)
    rebuilt = sorted(turns.rebuild_conversation(told, 5).collect(), key=lambda r: (r["conv_id"], r["part"]))
    assert all(r["n_turns"] <= 5 for r in rebuilt)
    listed = [(r["conv_id"], t["turn"], t["role"], t["text"]) for r in rebuilt for t in r["turns"]]
    assert listed == sorted(rows, key=lambda r: r[:2])
    assert max(len(r["history"]) for r in turns.with_history(told, 5).collect()) == 41
    calls = {(r["conv_id"], r["turn"]): r for r in turns.calls_from_turns(told, 5).collect()}
    assert calls[2, 2]["prompt_tokens"] == 40 * len("again") + len(rows[-2][3]) and calls[2, 2]["last_user"] == rows[-2][3]


def call(i, rollout, sequence, user=None, response=None, status="OK", **more):
    found = {"llm.model": more.pop("model", "m"), "llm.response.content": response, "llm.response.reasoning": more.pop("reasoning", None)}
    found["llm.request.messages"] = json.dumps([{"role": "user", "content": user}] if user else [])
    found["llm.usage.prompt_tokens"] = more.pop("tokens", None)
    attributes = json.dumps({k: v for k, v in found.items() if v is not None})
    return span(i, rollout, status=status, sequence_id=sequence, attributes=attributes)


def test_sft(spark):
    spans = table(
        spark,
        call(1, "A", 0, "q1", "r1", reasoning="because", tokens=3),
        call(2, "A", 1, "q2", ""),
        call(3, "A", 2, "q3", "r3", status="ERROR"),
        call(4, "B", 0, None, "r4"),
        span(5, attributes=json.dumps({"llm.response.content": "no call"})),
    )
    records = {r["id"]: r for r in exports.spans_to_sft(spans).collect()}
    assert {k: (r["prompt"], r["response"], r["thought_chain"]) for k, r in records.items()} == {
        "s0001": ("q1", "r1", "because"), "s0004": ("", "r4", None)}
    assert json.loads(records["s0001"]["metadata"])["attempt_id"] == "a"


@pytest.mark.parametrize("hot", [False, True])
def test_rl(spark, hot):
    """One rollout holds most spans; cut into parts of 4 it must still be one ordered trajectory."""
    rows = [call(i, "hot", i, f"q{i}" if i > 1 else None, f"r{i}" if i < 29 else None) for i in range(30)]
    rows += [call(100 + i, f"r{i}", 0, "q", f"x{i}") for i in range(5)]
    rewards = spark.createDataFrame([("hot", 1.0), ("r0", 0.0), ("r1", None), ("gone", 1.0)], "rollout_id STRING, reward DOUBLE")
    if hot:
        spark.conf.set("spanlake.skew.heavyRows", "10")
    try:
        records = exports.spans_to_rl(table(spark, *rows), rewards, part_spans=4).collect()
    finally:
        spark.conf.unset("spanlake.skew.heavyRows")
    long = sorted((r for r in records if r["rollout_id"] == "hot"), key=lambda r: r["part"])
    assert [r["part"] for r in long] == list(range(8))
    listed = [s for r in long for s in json.loads(r["trajectory"])]
    assert [s["span_id"] for s in listed] == [f"s{i:04d}" for i in range(30)]
    assert json.loads(listed[3]["attributes"])["llm.response.content"] == "r3"
    assert {(r["query"], r["response"], r["reward"], r["timestamp"], r["metadata"]) for r in long} == {
        ("q2", "r28", 1.0, 0.0, '{"n_spans":30}')}
    assert {r["rollout_id"]: r["reward"] for r in records} == {"hot": 1.0, "r0": 0.0, "r1": None, "r2": None, "r3": None, "r4": None}


RL = schemas.RL


def test_trl_and_hf_rl(spark):
    spans = [{"attributes": json.dumps({"llm.messages": "first"})}, {"attributes": json.dumps({"llm.response.content": "last"})}]
    old = [{"attributes": json.dumps({"llm.request.messages": "[1]"})}]
    rows = [
        ("a", "x", json.dumps(spans), None, None, None, None, 1.0, "{}", None),
        ("b", "x", json.dumps(old), None, "", "", "m", 1.0, "{}", None),
        ("c", "x", "[]", None, None, None, "", 1.0, "{}", None),
        ("d", "x", json.dumps(spans), None, "q", "r", "m", 1.0, "{}", None),
    ]
    records = spark.createDataFrame(rows, RL)
    trl = exports.trl_rl(records)
    assert "reward" not in trl.columns
    assert {r["rollout_id"]: (r["query"], r["response"]) for r in trl.collect()} == {
        "a": ("first", "last"), "b": ("[1]", ""), "c": ("", ""), "d": ("q", "r")}
    rewarded = records.withColumn("reward", F.when(F.col("rollout_id") == "d", 0.5))
    assert {r["rollout_id"]: r["reward"] for r in exports.trl_rl(rewarded).collect()}["d"] == 0.5
    hf = {r["rollout_id"]: r for r in exports.hf_rl(rewarded).collect()}
    assert (hf["a"]["query"], hf["a"]["reward"], hf["a"]["model"]) == ("", 0.0, "unknown")
    assert hf["d"]["reward"] == 0.5 and "part" not in exports.hf_rl(records).columns
    pairs = exports.build_pairs(
        records.withColumns({"query": F.lit("p"), "response": F.col("rollout_id"), "reward": F.when(F.col("rollout_id") != "c", F.ascii("rollout_id").cast("double"))})
    )
    assert [tuple(r) for r in pairs.collect()] == [("p", "d", "a")]
    tied = records.withColumns({"query": F.lit("p"), "response": F.lit("r"), "reward": F.lit(1.0)})
    assert exports.build_pairs(tied).count() == 0


def sft(spark, *rows):
    return spark.createDataFrame(rows, schemas.SFT)


def test_sft_formats(spark):
    records = sft(
        spark,
        ("1", "p", "r", None, None, "ro", 1.0, "{}", None, None, None),
        ("2", "p2", "r2", "hm", "", "ro", 2.0, "{}", 5, None, 7),
    )
    conv = {r["id"]: [tuple(m) for m in r["messages"]] for r in exports.trl_sft(records).collect()}
    assert conv["2"] == [("user", "p2"), ("assistant", "r2")]
    thought = {r["id"]: [tuple(m) for m in r["messages"]] for r in exports.trl_sft(records, include_thoughts=True).collect()}
    assert thought["1"] == [("user", "p"), ("assistant", "r")] and thought["2"][0] == ("system", "hm")
    assert exports.trl_sft(records, "text").first()["text"] == "User: p\nAssistant: r"
    assert exports.trl_sft(records, "instruction").first()["input"] == ""
    with pytest.raises(ValueError):
        exports.trl_sft(records, "poem")
    hf = {r["id"]: r for r in exports.hf_sft(records).collect()}
    assert hf["1"]["model"] == "unknown" and hf["1"]["thought_chain"] == "" and hf["2"]["completion_tokens"] == 0
    bare = exports.hf_sft(records.where("id = '1'"))
    assert "thought_chain" not in bare.columns and "prompt_tokens" not in bare.columns
    thoughts = spark.createDataFrame([("p", "new"), ("p", "other"), ("p2", "new")], "prompt STRING, thought_chain STRING")
    filled = {r["id"]: r["thought_chain"] for r in joins.attach_reasoning(records, thoughts, ["prompt"]).collect()}
    assert filled == {"1": "other", "2": "hm"}


def test_export_files(spark):
    source, target = scratch_path(spark, "sft"), scratch_path(spark, "out")
    records = sft(spark, *[(str(i), f"p{i}", "r", None, "m", "ro", 1.0, None, None, None, None) for i in range(50)])
    records.drop("thought_chain", "prompt_tokens").write.parquet(source)  # optional columns may be missing
    exports.export(spark, source, target, "hf", "sft", split_train_test=True)
    train, test = (spark.read.parquet(f"{target}/{s}") for s in ("train", "test"))
    assert train.count() + test.count() == 50 and train.join(test, "id").count() == 0
    with pytest.raises(ValueError):
        exports.export(spark, source, target, "csv")


@pytest.mark.parametrize("size", [0.1, 0.25, 0.5])
def test_exact_split(spark, size):
    """A third of the rows are copies of one key; the test part still has exactly the wanted size."""
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("id"))
    train, test = exports.train_test_split(rows, ["id"], size, exact=True)
    assert test.count() == math.ceil(300 * size)
    assert sorted(r[0] for r in train.unionAll(test).collect()) == sorted(r[0] for r in rows.collect())
    single = exports.train_test_split(spark.range(1), ["id"])
    assert (single[0].count(), single[1].count()) == (1, 0)
