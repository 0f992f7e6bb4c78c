import json

import pytest
from pyspark.sql import functions as F

from spanlake import schemas
from spanlake.operators import capture, joins, sanitize

MESSAGES = [{"role": "system", "content": "be brief"}, {"role": "user", "content": "hi", "name": "ann"}]


def build(spark, *calls):
    """Attributes of the spans of (kwargs, response, error) triples, and the spans."""
    rows = [
        (f"c{i}", kw if isinstance(kw, str) else json.dumps(kw), None if r is None else json.dumps(r), e, 1.0, 2.5)
        for i, (kw, r, e) in enumerate(calls)
    ]
    raw = spark.createDataFrame(rows, schemas.RAW_CALL)
    spans = capture.build_spans(raw).collect()
    by_start = {capture_id: s for capture_id, s in zip([r[0] for r in rows], spans)}
    return [json.loads(s["attributes"]) for s in by_start.values()], spans


def test_chat_completion(spark):
    calls = [{"id": "t1", "type": "function", "function": {"name": "f", "arguments": "{}"}, "index": 0}]
    response = {
        "choices": [
            {
                "message": {"content": "hello", "reasoning_content": "", "tool_calls": calls},
                "provider_specific_fields": {"reasoning": "why", "token_ids": [5, 6]},
            }
        ],
        "usage": {"prompt_tokens": 7, "details": {"x": 1}},
        "prompt_token_ids": [1, 2, 3],
    }
    kwargs = {"model": "m", "messages": MESSAGES, "temperature": 0, "max_tokens": 10, "tools": [{"n": 1}], "provider": "p"}
    (a,), (span,) = build(spark, (kwargs, response, None))
    assert a["llm.model"] == "m"
    assert json.loads(a["llm.request.messages"]) == MESSAGES[1:]
    assert a["llm.request.system"] == "be brief"
    assert a["llm.request.temperature"] == 0 and a["llm.request.max_tokens"] == 10
    assert "llm.request.top_p" not in a
    assert json.loads(a["llm.request.tools"]) == [{"n": 1}]
    assert a["llm.response.content"] == "hello" and a["llm.response.reasoning"] == "why"
    assert json.loads(a["llm.response.tool_calls"]) == [{k: v for k, v in calls[0].items() if k != "index"}]
    assert a["llm.provider.token_ids"] == "[5, 6]" and a["llm.prompt_token_ids"] == "[1, 2, 3]"
    counters = [a[f"llm.usage.{c}_tokens"] for c in ("prompt", "completion", "total")]
    assert counters == [7, 0, 0]
    assert "llm.conversation.tool_results" not in a
    assert (span["name"], span["kind"], span["status"]) == ("llm.completion", "CLIENT", "OK")
    assert json.loads(span["resource_attributes"]) == {"service.name": "spanlake", "llm.provider": "p"}
    assert len(span["span_id"]) == 16 and len(span["trace_id"]) == 32


def test_block_and_output_styles(spark):
    blocks = {
        "content": [
            {"type": "text", "text": "a"},
            {"type": "tool_use", "id": "t", "name": "f", "input": {"b": 1, "a": [2]}},
            {"type": "text", "text": "b"},
        ],
        "usage": {},
    }
    output = {
        "output": [
            {"type": "ResponseReasoningItem", "content": [{"text": "r1"}, {"text": "r2"}]},
            {"type": "message", "content": [{"type": "output_text", "text": "x"}, {"type": "refusal", "text": "no"}]},
            {"type": "message", "content": [{"type": "tool_use", "id": "t", "name": "f"}, {"type": "output_text", "text": ""}]},
            {"type": "other", "content": [{"type": "output_text", "text": "hidden"}]},
            {"type": "message", "content": None},
        ],
        "choices": [{"message": {"content": "ignored"}}],
        "usage": {"total_tokens": 9},
    }
    (b, o), _ = build(spark, ({"litellm_params": {"messages": MESSAGES, "model": "inner"}}, blocks, None),
                      ({"data": {"messages": MESSAGES[1:]}}, output, None))
    assert b["llm.response.content"] == "ab" and b["llm.model"] == "inner"
    assert json.loads(b["llm.response.tool_calls"]) == [{"id": "t", "name": "f", "input": {"b": 1, "a": [2]}}]
    assert "llm.usage.total_tokens" not in b and "llm.response.reasoning" not in b
    assert o["llm.response.content"] == "x" and o["llm.response.reasoning"] == "r1r2" and o["llm.model"] == "unknown"
    assert json.loads(o["llm.response.tool_calls"]) == [{"id": "t", "name": "f", "input": None}]
    assert [o[f"llm.usage.{c}_tokens"] for c in ("prompt", "completion", "total")] == [0, 0, 9]
    assert "llm.request.system" not in o


def test_request_edge_rows(spark):
    tool = {"role": "tool", "tool_call_id": "t1", "content": [{"type": "text", "text": "part"}]}
    rows = [
        ({"model": "m", "messages": [{"role": "system", "content": None}]}, {"choices": []}, None),
        ({"model": "m", "messages": [MESSAGES[1], tool, {"role": "tool", "content": "bare"}]}, {"choices": []}, None),
        ({"model": "m", "messages": [MESSAGES[1]], "litellm_params": {"messages": MESSAGES}}, {}, None),
        ({"model": "m"}, {"content": "just text"}, None),
        ({"model": "m", "messages": MESSAGES}, None, None),
        ({"model": "m", "messages": MESSAGES}, {"error": 1}, "boom"),
    ]
    attributes, spans = build(spark, *rows)
    assert attributes[0]["llm.request.messages"] == "[]" and "llm.request.system" not in attributes[0]
    assert json.loads(attributes[1]["llm.conversation.tool_results"]) == [
        {"tool_call_id": "t1", "content": tool["content"]},
        {"tool_call_id": None, "content": "bare"},
    ]
    assert json.loads(attributes[1]["llm.request.messages"])[1] == tool
    assert json.loads(attributes[2]["llm.request.messages"]) == [MESSAGES[1]]
    assert attributes[3]["llm.request.messages"] == "[]" and "llm.response.content" not in attributes[3]
    assert attributes[4]["llm.error"] == "Unknown error" and attributes[5]["llm.error"] == "boom"
    assert [s["status"] for s in spans] == ["OK"] * 4 + ["ERROR"] * 2
    assert set(attributes[5]) == {"llm.model", "llm.request.messages", "llm.request.system", "llm.error"}


def test_hook_data(spark):
    """The payload of the hook counts only when the arguments hold none themselves."""
    kwargs = [{"model": "a"}, {"data": "text"}, {"messages": [], "model": "b"}]
    hook = json.dumps({"model": "h", "messages": [{"role": "user", "content": "hooked"}]})
    rows = [(str(i), json.dumps(k), "{}", None, 1.0, 2.0, hook) for i, k in enumerate(kwargs)]
    raw = spark.createDataFrame(rows, f"{schemas.RAW_CALL}, hook_data STRING")
    attributes = [json.loads(r["attributes"]) for r in capture.build_success(raw).collect()]
    assert ["hooked" in a["llm.request.messages"] for a in attributes] == [True, True, False]
    assert [a["llm.model"] for a in attributes] == ["a", "h", "b"]


def test_quarantine(spark):
    kwargs = ['{"messages": []}', '{"model": "m"}', "{oops", "[1]", '{"messages": null}', '{"messages": [1]}', '{"messages": "x"}']
    rows = [(str(i), k, None, None, 1.0, 2.0) for i, k in enumerate(kwargs)] + [("late", kwargs[0], None, None, None, 2.0)]
    raw = spark.createDataFrame(rows, schemas.RAW_CALL)
    good, bad = capture.split_malformed(raw)
    assert sorted(r["call_id"] for r in good.collect()) == ["0", "1"]
    assert good.count() + bad.count() == len(rows)


def test_quarantine_of_hook_data(spark):
    rows = [(str(i), "{}", None, None, 1.0, 2.0, h) for i, h in enumerate(['{"messages": [{"role": "user"}]}', '{"messages": [1]}', '{"messages": "x"}', None])]
    good, bad = capture.split_malformed(spark.createDataFrame(rows, f"{schemas.RAW_CALL}, hook_data STRING"))
    assert sorted(r["call_id"] for r in good.collect()) == ["0", "3"] and sorted(r["call_id"] for r in bad.collect()) == ["1", "2"]


def test_prefix_match(spark):
    df = spark.createDataFrame([("gemini-pro",), ("gpt-4",), ("claude",), (None,), ("",)], "model STRING")
    prefixes = spark.createDataFrame([("gemini",), ("gpt-4",), ("gpt-44",)], "prefix STRING")
    found = sanitize.match_model_prefix(df, prefixes).collect()
    assert {r["model"]: r["matched"] for r in found} == {"gemini-pro": True, "gpt-4": True, "claude": False, None: False, "": False}
    everything = sanitize.match_model_prefix(df, prefixes.limit(0))
    assert all(r["matched"] for r in everything.collect())
    blank = sanitize.match_model_prefix(df, prefixes.union(spark.createDataFrame([("",)], "prefix STRING")))
    assert all(r["matched"] for r in blank.collect())


def test_prefix_join(spark, heavy):
    """The list as a table against the list in the plan, with heavy, null and odd models."""
    models = ["gemini-pro"] * 15 + ["gpt-4", "claude", None, "", "g", "é-1", "gemini"] + [f"m{i}-x" for i in range(30)]
    df = spark.createDataFrame([(m, i) for i, m in enumerate(models)], "model STRING, _length INT")
    prefixes = spark.createDataFrame([(p,) for p in ["gemini", "gpt-4", "gpt-44", "é", None, "gpt-4"] + [f"m{i}" for i in range(0, 30, 3)]], "prefix STRING")
    for more in ([], [("",)]):
        listed = prefixes.union(spark.createDataFrame(more, "prefix STRING"))
        want = sanitize.match_model_prefix(df, listed).collect()
        assert sorted(sanitize.match_model_prefix(df, listed, in_plan=3).collect(), key=str) == sorted(want, key=str) and len(want) == len(models)


def test_sanitize(spark):
    models = spark.createDataFrame(
        [("gem", ("openai/gemini-x", None, None)), ("Gemini-2", ("other/y", None, True)), ("gpt", ("openai/gpt", None, True)),
         ("gemini-3", ("gemini/z", None, False))],
        f"model_name STRING, litellm_params {'STRUCT<model: STRING, api_base: STRING, drop_params: BOOLEAN>'}",
    )
    assert sorted(r[0] for r in sanitize.sanitize_model_set(models).collect()) == ["Gemini-2", "gem"]
    data = {"tools": [1], "tool_choice": "auto", "tool_use": 1, "parallel_tool_calls": True, "temperature": 0.70, "z": {"b": 1, "a": 2}}
    rows = [
        ("hit", json.dumps({"model": "gem-large", "data": data, "tools": [1]})),
        ("miss", json.dumps({"model": "gpt", "data": data})),
        ("inner", json.dumps({"model": "", "litellm_params": {"model": "gem"}, "data": data})),
        ("text", json.dumps({"model": "gem", "data": "none"})),
    ]
    done = sanitize.sanitize_requests(spark.createDataFrame(rows, "id STRING, kwargs STRING"), models)
    got = {r["id"]: json.loads(r["kwargs"]) for r in done.collect()}
    kept = {"temperature": 0.7, "z": {"a": 2, "b": 1}}
    assert got["hit"] == {"model": "gem-large", "data": kept, "tools": [1]}
    assert got["miss"]["data"] == data
    assert got["inner"]["data"] == kept
    assert got["text"]["data"] == "none"


def test_tool_results_join(spark, heavy):
    def attributes(calls=None, results=None):
        found = {"llm.response.tool_calls": calls, "llm.conversation.tool_results": results}
        return json.dumps({k: json.dumps(v) for k, v in found.items() if v is not None})

    rows = [("r", "s1", 1.0, attributes(calls=[{"id": "a", "function": {"name": "f"}}, {"id": None, "name": "g"}]))]
    rows += [("r", f"s{i}", float(i), attributes(results=[{"tool_call_id": "a", "content": f"v{i}"}])) for i in range(2, 30)]
    rows += [("q", "s40", 1.0, attributes(calls=[{"id": "a", "name": "h"}] * 20))]
    spans = spark.createDataFrame(rows, "rollout_id STRING, span_id STRING, start_time DOUBLE, attributes STRING")
    found = [tuple(r[c] for c in ("rollout_id", "tool_call_id", "tool", "result")) for r in joins.join_tool_results(spans).collect()]
    assert sorted(found, key=str) == sorted(
        [("r", "a", "f", "v2"), ("r", None, "g", None)] + [("q", "a", "h", None)] * 20, key=str
    )
