"""Registered queries on training-set exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, turns
from ..plans import exports as ops
from ..session import scratch_path
from ..sinks import export_parquet, export_splits
from . import fixtures as fx
from .registry import registry
from .spans import chained

QUERIES, ORACLE, query = registry()

# SFT records of the captured spans, which carry reasoning.
_SFT = (
    fx.RAW
    + """,
sft AS (
  SELECT captured_id AS id, coalesce(last_user, '') AS prompt, response, reasoning AS thought_chain, model, rollout_id,
    start_time AS "timestamp", prompt_tokens, completion_tokens, total_tokens
  FROM captured WHERE NOT failed AND length(response) > 0
)"""
)


def _sft(spark, folder):
    return ops.spans_to_sft(fx.captured(spark, folder))


def _json(df, column="messages"):
    return df.withColumn(column, F.to_json(column))


SFT_WHOLE = f"""WITH {_SFT} SELECT s.*, '{{"attempt_id":"' || c.attempt_id || '","sequence_id":' || c.sequence_id::VARCHAR || ',"trace_id":"'
    || substr(sha256(c.call_id), 1, 32) || '"}}' AS metadata FROM sft s JOIN captured c ON c.captured_id = s.id"""


@query("sft_records", SFT_WHOLE)
def sft_records(spark, folder):
    return _sft(spark, folder)


_PAIR = """{'role': 'user', 'content': prompt}, {'role': 'assistant', 'content': response}"""


@query("trl_conversational", f"""WITH {_SFT} SELECT to_json([{_PAIR}])::VARCHAR AS messages, id, model, "timestamp" FROM sft""")
def trl_conversational(spark, folder):
    return _json(ops.trl_sft(_sft(spark, folder)))


@query("trl_instruction", f"WITH {_SFT} SELECT prompt AS instruction, '' AS input, response AS output, id, model FROM sft")
def trl_instruction(spark, folder):
    return ops.trl_sft(_sft(spark, folder), "instruction")


@query(
    "trl_text", f"WITH {_SFT} SELECT 'User: ' || prompt || chr(10) || 'Assistant: ' || response AS text, id, model FROM sft"
)
def trl_text(spark, folder):
    return ops.trl_sft(_sft(spark, folder), "text")


@query(
    "sft_with_reasoning",
    f"""WITH {_SFT} SELECT CASE WHEN length(thought_chain) > 0
    THEN to_json([{{'role': 'system', 'content': thought_chain}}, {_PAIR}])::VARCHAR ELSE to_json([{_PAIR}])::VARCHAR END
    AS messages, id, model, "timestamp" FROM sft""",
)
def sft_with_reasoning(spark, folder):
    return _json(ops.trl_sft(_sft(spark, folder), include_thoughts=True))


@query(
    "attach_reasoning",
    f"""WITH {_SFT}, thoughts AS (SELECT 'ro-' || lpad(conv_id::VARCHAR, 12, '0') AS rollout_id, max(text) AS thought
    FROM conversations WHERE role = 'user' GROUP BY 1)
    SELECT s.id, s.rollout_id, coalesce(s.thought_chain, t.thought) AS thought_chain
    FROM sft s LEFT JOIN thoughts t USING (rollout_id)""",
)
def attach_reasoning(spark, folder):
    rollout = F.concat(F.lit("ro-"), F.lpad(F.col("conv_id").cast("string"), 12, "0"))
    told = fx.table(spark, folder, "conversations").where(F.col("role") == "user")
    thoughts = told.select(rollout.alias("rollout_id"), F.col("text").alias("thought_chain"))
    records = _sft(spark, folder).select("id", "rollout_id", "thought_chain")
    return joins.attach_reasoning(records, thoughts, ["rollout_id"])


@query(
    "hf_sft",
    f"""WITH {_SFT} SELECT id, prompt, response, model, "timestamp", coalesce(thought_chain, '') AS thought_chain,
    prompt_tokens, completion_tokens, total_tokens FROM sft""",
)
def hf_sft(spark, folder):
    return ops.hf_sft(_sft(spark, folder))


@query("hf_sft_bare", f"""WITH {_SFT} SELECT id, prompt, response, 'unknown' AS model, "timestamp" FROM sft""")
def hf_sft_bare(spark, folder):
    bare = _sft(spark, folder).withColumns(
        {"thought_chain": F.lit(""), "prompt_tokens": F.lit(0).cast("bigint"), "model": F.lit("")}
    )
    return ops.hf_sft(bare)


_RL = (
    fx.SPANS
    + ","
    + fx.REWARDS
    + """,
rl AS (
  SELECT s.rollout_id, s.attempt_id, string_agg(span_id, ',' ORDER BY sequence_id) AS span_ids,
    count(*)::BIGINT AS n_spans, any_value(w.reward) AS reward, arg_min(last_user, sequence_id) AS query,
    arg_max(response, sequence_id) AS response, any_value(model) AS model, min(start_time) AS "timestamp"
  FROM spans s LEFT JOIN rewards w ON w.rollout_id = s.rollout_id GROUP BY 1, 2
)"""
)


def _rl(spark, folder, **options):
    return ops.spans_to_rl(fx.spans(spark, folder), fx.rewards(spark, folder), **options)


def _with_span_ids(rl):
    listed = F.from_json("trajectory", "ARRAY<STRUCT<span_id: STRING>>")
    return rl.withColumn("span_ids", F.array_join(F.transform(listed, lambda s: s["span_id"]), ",")).drop("trajectory")


@query(
    "rl_records",
    f"""WITH {_RL} SELECT rollout_id, attempt_id, 0::BIGINT AS part, span_ids, reward, query, response, model,
    "timestamp", '{{"n_spans":' || n_spans::VARCHAR || '}}' AS metadata FROM rl""",
)
def rl_records(spark, folder):
    return _with_span_ids(_rl(spark, folder))


@query(
    "rl_records_long",
    f"""WITH {_RL}, placed AS (SELECT *, (sequence_id // 2)::BIGINT AS part FROM spans)
    SELECT p.rollout_id, p.attempt_id, part, string_agg(span_id, ',' ORDER BY sequence_id) AS span_ids,
    any_value(rl.query) AS query, any_value(rl.response) AS response, any_value(rl.reward) AS reward,
    any_value(rl.n_spans) AS n_spans
    FROM placed p JOIN rl USING (rollout_id, attempt_id) GROUP BY p.rollout_id, p.attempt_id, part""",
)
def rl_records_long(spark, folder):
    """Trajectories cut into parts of two spans: what a trajectory beyond the part size looks like."""
    parts = _with_span_ids(_rl(spark, folder, part_spans=2))
    return parts.select(
        "rollout_id",
        "attempt_id",
        "part",
        "span_ids",
        "query",
        "response",
        "reward",
        F.get_json_object("metadata", "$.n_spans").cast("bigint").alias("n_spans"),
    )


@query(
    "trl_rl",
    f"""WITH {_RL} SELECT coalesce(query, '') AS query, coalesce(response, '') AS response, rollout_id, attempt_id, model,
    reward FROM rl""",
)
def trl_rl(spark, folder):
    return ops.trl_rl(_rl(spark, folder))


@query(
    "trl_rl_long",
    f"""WITH {_RL}, ends AS (SELECT rollout_id, attempt_id, arg_max(response, sequence_id) AS last_response FROM spans GROUP BY 1, 2)
    SELECT coalesce(query, '') AS query, last_response AS response, rollout_id, attempt_id, model, reward
    FROM rl JOIN ends USING (rollout_id, attempt_id)""",
)
def trl_rl_long(spark, folder):
    """One span per part and no response in the records: the response is that of the last span of the whole trajectory."""
    bare = _rl(spark, folder, part_spans=1).withColumn("response", F.lit(None).cast("string"))
    return ops.trl_rl(bare)


@query(
    "hf_rl_long",
    f"""WITH {_RL} SELECT rollout_id, attempt_id, span_ids, coalesce(query, '') AS query, coalesce(response, '') AS response,
    coalesce(reward, 0.0) AS reward, model, "timestamp" FROM rl""",
)
def hf_rl_long(spark, folder):
    """Two spans per part: still one row per trajectory, with all its spans in order."""
    return _with_span_ids(ops.hf_rl(_rl(spark, folder, part_spans=2)))


@query(
    "trl_rl_from_trajectory",
    f"""WITH {_RL}, ends AS (SELECT rollout_id, attempt_id, to_json(arg_min(messages, sequence_id))::VARCHAR AS query,
    arg_max(response, sequence_id) AS response, any_value(model) AS model FROM spans GROUP BY 1, 2)
    SELECT query, response, rollout_id, attempt_id, model FROM ends""",
)
def trl_rl_from_trajectory(spark, folder):
    """Records without query, response and reward: the trajectory gives the first two, the third is left out."""
    bare = ops.spans_to_rl(fx.spans(spark, folder)).withColumns({"query": F.lit(""), "response": F.lit(None).cast("string")})
    return ops.trl_rl(bare)


@query(
    "hf_rl",
    f"""WITH {_RL} SELECT rollout_id, attempt_id, coalesce(query, '') AS query, response, coalesce(reward, 0.0::DOUBLE) AS reward,
    model, "timestamp", span_ids FROM rl""",
)
def hf_rl(spark, folder):
    return _with_span_ids(ops.hf_rl(_rl(spark, folder)))


@query(
    "reward_pairs",
    f"WITH {fx.SPANS} SELECT coalesce(last_user, '') AS prompt, response AS chosen, reverse(response) AS rejected FROM spans",
)
def reward_pairs(spark, folder):
    records = fx.calls(spark, folder).select(
        F.coalesce("last_user", F.lit("")).alias("prompt"),
        F.col("response").alias("chosen"),
        F.reverse("response").alias("rejected"),
        "model",
    )
    return ops.reward_pairs(records)


@query(
    "build_pairs",
    f"""WITH {_RL}, rated AS (SELECT *, {{'reward': reward, 'r': rollout_id, 'a': attempt_id}} AS place FROM rl
    WHERE reward IS NOT NULL)
    SELECT model AS prompt, arg_max(response, place) AS chosen, arg_min(response, place) AS rejected FROM rated
    GROUP BY model HAVING max(reward) > min(reward)""",
)
def build_pairs(spark, folder):
    """Rollouts of one model compete, since the given conversations have no repeated query."""
    return ops.build_pairs(_rl(spark, folder).withColumn("query", F.col("model")))


def _slot(key: str, slots: int) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % {slots})"


def _sides(train, test, key):
    return train.select(key, F.lit("train").alias("side")).unionByName(test.select(key, F.lit("test").alias("side")))


@query(
    "train_test_split",
    f"""WITH {_SFT} SELECT id, CASE WHEN {_slot('id', 10000)} < 1000 THEN 'test' ELSE 'train' END AS side FROM sft""",
)
def train_test_split(spark, folder):
    return _sides(*ops.train_test_split(_sft(spark, folder), ["id"]), "id")


@query(
    "train_test_split_exact",
    f"""WITH placed AS (SELECT event_id, row_number() OVER (ORDER BY {_slot('event_id::VARCHAR', 65536)}, event_id) AS n,
    count(*) OVER () AS total FROM events)
    SELECT event_id, CASE WHEN n <= ceil(total * 0.25) THEN 'test' ELSE 'train' END AS side FROM placed""",
)
def train_test_split_exact(spark, folder):
    events = fx.table(spark, folder, "events").select("event_id")
    return _sides(*ops.train_test_split(events, ["event_id"], 0.25, exact=True), "event_id")


@query(
    "export_trl_sft",
    f"""WITH {_SFT} SELECT to_json([{_PAIR}])::VARCHAR AS messages, id, model, "timestamp" FROM sft""",
)
def export_trl_sft(spark, folder):
    """Records are written, exported from the files, and the training set is read back."""
    source, target = scratch_path(spark, "sft"), scratch_path(spark, "trl")
    export_parquet(_sft(spark, folder), source)
    ops.export(spark, source, target)
    return _json(spark.read.parquet(target))


@query(
    "export_hf_rl",
    f"""WITH {_RL} SELECT rollout_id, attempt_id, coalesce(query, '') AS query, response, coalesce(reward, 0.0::DOUBLE) AS reward,
    model, "timestamp", span_ids FROM rl""",
)
def export_hf_rl(spark, folder):
    source, target = scratch_path(spark, "rl"), scratch_path(spark, "hf")
    export_parquet(_rl(spark, folder), source)
    ops.export(spark, source, target, format="hf", type="rl")
    return _with_span_ids(spark.read.parquet(target))


def _exported(spark, records, **options):
    """Records written, exported from the files, and the training set read back."""
    source, target = scratch_path(spark, "records"), scratch_path(spark, "exported")
    export_parquet(records, source)
    ops.export(spark, source, target, **options)
    return target


@query("export_trl_rl", ORACLE["trl_rl"])
def export_trl_rl(spark, folder):
    return spark.read.parquet(_exported(spark, _rl(spark, folder), type="rl"))


@query("export_hf_sft", ORACLE["hf_sft"])
def export_hf_sft(spark, folder):
    return spark.read.parquet(_exported(spark, _sft(spark, folder), format="hf"))


@query("export_trl_thoughts", ORACLE["sft_with_reasoning"])
def export_trl_thoughts(spark, folder):
    return _json(spark.read.parquet(_exported(spark, _sft(spark, folder), include_thoughts=True)))


@query("export_trl_text", ORACLE["trl_text"])
def export_trl_text(spark, folder):
    return spark.read.parquet(_exported(spark, _sft(spark, folder), sft_format="text"))


@query(
    "export_hf_split",
    f"""WITH {_SFT} SELECT CASE WHEN {_slot('id', 10000)} < 2500 THEN 'test' ELSE 'train' END AS side, id, prompt, response FROM sft""",
)
def export_hf_split(spark, folder):
    target = _exported(spark, _sft(spark, folder), format="hf", split_train_test=True, test_size=0.25)
    sides = [spark.read.parquet(f"{target}/{side}").withColumn("side", F.lit(side)) for side in ("train", "test")]
    return sides[0].unionByName(sides[1]).select("side", "id", "prompt", "response")


@query(
    "export_splits",
    f"""WITH {_SFT} SELECT CASE WHEN {_slot('id', 10000)} < 2000 THEN 'test' ELSE 'train' END AS side, count(*) AS records,
    sum(total_tokens)::BIGINT AS total_tokens FROM sft GROUP BY 1""",
)
def splits(spark, folder):
    target = scratch_path(spark, "splits")
    export_splits(*ops.train_test_split(_sft(spark, folder), ["id"], 0.2), target)
    sides = [spark.read.parquet(f"{target}/{side}").withColumn("side", F.lit(side)) for side in ("train", "test")]
    return sides[0].unionByName(sides[1]).groupBy("side").agg(
        F.count("*").alias("records"), F.sum("total_tokens").alias("total_tokens")
    )


@query(
    "rebuild_conversation",
    """SELECT conv_id, 0::BIGINT AS part, to_json(list({'turn': turn, 'role': role, 'text': text} ORDER BY turn))::VARCHAR AS turns,
    count(*) AS n_turns FROM conversations GROUP BY conv_id""",
)
def rebuild_conversation(spark, folder):
    return _json(turns.rebuild_conversation(fx.table(spark, folder, "conversations")), "turns")


@query(
    "multi_turn_sft",
    """SELECT conv_id, 0::BIGINT AS part, to_json(list({'role': role, 'content': text} ORDER BY turn))::VARCHAR AS messages,
    count(*) AS n_turns FROM conversations GROUP BY conv_id""",
)
def multi_turn_sft(spark, folder):
    return _json(turns.multi_turn_sft(fx.table(spark, folder, "conversations")))


_LONG = """WITH chained AS (SELECT conv_id // 20 AS conv_id, (conv_id % 20) * 1000 + turn AS turn, role, text FROM conversations),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM chained)"""


@query(
    "rebuild_conversation_long",
    f"""{_LONG} SELECT conv_id, (place // 7)::BIGINT AS part, to_json(list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn))::VARCHAR AS turns,
    count(*) AS n_turns FROM placed GROUP BY 1, 2""",
)
def rebuild_conversation_long(spark, folder):
    return _json(turns.rebuild_conversation(chained(spark, folder), part_turns=7), "turns")


@query(
    "multi_turn_sft_long",
    f"""{_LONG}, ends AS (SELECT conv_id, place // 7 AS part, max(place) AS last, count(*) AS n_turns FROM placed GROUP BY 1, 2)
    SELECT e.conv_id, e.part::BIGINT AS part, to_json(list({{'role': role, 'content': text}} ORDER BY place))::VARCHAR AS messages, any_value(n_turns) AS n_turns
    FROM ends e JOIN placed p ON p.conv_id = e.conv_id AND p.place <= e.last GROUP BY 1, 2""",
)
def multi_turn_sft_long(spark, folder):
    """The messages of a part are all of the conversation up to its end."""
    return _json(turns.multi_turn_sft(chained(spark, folder), part_turns=7))


@query(
    "multi_turn_sft_whole",
    f"""{_LONG} SELECT conv_id, to_json(list({{'role': role, 'content': text}} ORDER BY turn))::VARCHAR AS messages, count(*) AS n_turns
    FROM chained GROUP BY conv_id""",
)
def multi_turn_sft_whole(spark, folder):
    """The last part of each conversation holds all of it, whatever the size of parts."""
    parts = turns.multi_turn_sft(chained(spark, folder), part_turns=7)
    last = parts.groupBy("conv_id").agg(F.max_by("messages", "part").alias("messages"), F.sum("n_turns").alias("n_turns"))
    return _json(last)
