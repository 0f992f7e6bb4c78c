"""Tool traffic over the given ``conversations``, which hold plain turns: derived by fixed rules, with SQL that says the same.

An assistant turn asks two tools: ``measure`` (its text and length) and then ``look_up`` (the text in lower case), which depends on
the first and is written before it. Each following user turn answers both calls of the turn before it. By the turn number some calls have a missing or a
wrong argument, or name a tool that does not exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tool_calls import quoted

SCHEMAS = {
    "measure": {"text": ("string", True), "length": ("integer", True), "ratio": ("number", False)},
    "look_up": {"query": ("string", True), "exact": ("boolean", False), "tags": ("array", False)},
}


def derive_messages(conversations: DataFrame) -> DataFrame:
    turns = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    wrong = F.when(F.col("turn") % 5 == 3, F.concat(F.lit('"'), size.cast("string"), F.lit('"'))).otherwise(size.cast("string"))
    first = F.concat(F.lit('{ "text": '), quoted(F.col("text")), F.when(F.col("turn") % 7 != 5, F.concat(F.lit(', "length": '), wrong)).otherwise(""), F.lit(', "ratio": 1.50 }'))
    second = F.concat(F.lit('{"query":'), quoted(F.lower("text")), F.lit(', "exact": true, "tags": ["b", "a"]'), F.when(size % 4 == 0, F.lit(', "limit": 3')).otherwise(""), F.lit("}"))
    m, q = F.format_string("m%d", "turn"), F.format_string("q%d", "turn")
    call = lambda i, n, a, d: F.struct(i.alias("id"), n.alias("name"), a.alias("arguments"), d.alias("depends_on"))
    none = F.array().cast("array<string>")
    calls = F.array(
        call(q, F.when(size % 11 == 0, "search").otherwise("look_up"), second, F.array(m)),
        call(m, F.lit("measure"), first, none),
    )
    told = turns.select("conv_id", "turn", "role", F.col("text").alias("content"), F.when(F.col("role") == "assistant", calls).alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"))
    answers = turns.where("role = 'user'").select(
        "conv_id",
        "turn",
        F.lit("tool").alias("role"),
        F.col("text").alias("content"),
        F.lit(None).cast(told.schema["tool_calls"].dataType).alias("tool_calls"),
        F.explode(F.array(F.format_string("m%d", F.col("turn") - 1), F.format_string("q%d", F.col("turn") - 1))).alias("tool_call_id"),
    )
    return told.unionByName(answers)


SQL = r"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
     k AS (SELECT *, CAST(to_json(text) AS VARCHAR) AS quoted, CAST(to_json(lower(text)) AS VARCHAR) AS low, length(text) AS size FROM t),
     a AS (SELECT * FROM k WHERE role = 'assistant'),
     c AS (
       SELECT conv_id, turn, 0 AS call, 'm' || turn AS call_id,
              '{"arguments":{' || CASE WHEN turn % 7 = 5 THEN '' WHEN turn % 5 = 3 THEN '"length":"' || size || '",' ELSE '"length":' || size || ',' END
              || '"ratio":1.5,"text":' || quoted || '},"id":"m' || turn || '","name":"measure"}' AS json,
              CASE WHEN turn % 7 = 5 THEN 'missing:length' WHEN turn % 5 = 3 THEN 'type:length' ELSE '' END AS errors FROM a
       UNION ALL
       SELECT conv_id, turn, 1, 'q' || turn,
              '{"arguments":{"exact":true,' || CASE WHEN size % 4 = 0 THEN '"limit":3,' ELSE '' END || '"query":' || low || ',"tags":["b","a"]},"id":"q' || turn
              || '","name":"' || CASE WHEN size % 11 = 0 THEN 'search' ELSE 'look_up' END || '"}',
              CASE WHEN size % 11 = 0 THEN 'unknown_tool' WHEN size % 4 = 0 THEN 'unknown:limit' ELSE '' END FROM a),
     r AS (SELECT conv_id, turn AS result_turn, text, quoted, unnest([0, 1]) AS call, turn - 1 AS ask FROM k WHERE role = 'user'),
     l AS (SELECT r.*, c.turn AS ask_turn, (CASE WHEN r.call = 0 THEN 'm' ELSE 'q' END) || r.ask AS call_id
           FROM r LEFT JOIN c ON c.conv_id = r.conv_id AND c.turn = r.ask AND c.call = r.call)
SELECT conv_id, turn, -1 AS call, 0 AS step, CAST(NULL AS BIGINT) AS result_turn, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id,
       CAST(NULL AS BOOLEAN) AS linked, '' AS errors, FALSE AS cyclic, '{"content":' || quoted || ',"role":' || CAST(to_json(coalesce(role, '')) AS VARCHAR) || '}' AS json FROM k
UNION ALL
SELECT conv_id, turn, call, 0, NULL, 'call', call_id, EXISTS (SELECT 1 FROM r WHERE r.conv_id = c.conv_id AND r.ask = c.turn), errors, FALSE, json FROM c
UNION ALL
SELECT conv_id, coalesce(ask_turn, result_turn), CASE WHEN ask_turn IS NULL THEN -1 ELSE call END, 1, result_turn,
       CASE WHEN ask_turn IS NULL THEN 'orphan' ELSE 'result' END, call_id, ask_turn IS NOT NULL, '', FALSE,
       '{"content":' || quoted || ',"role":"tool","tool_call_id":"' || call_id || '"}' FROM l
"""
