"""Removal of request parameters that some models reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .skew import join_unique

# The request parameters to remove.
SANITIZED_PARAMS = ("tool_choice", "tools", "tool_use", "parallel_tool_calls")

# Prefixes of a longer list do not go into the plan but are joined.
PLAN_PREFIXES = 10_000


def sanitize_model_set(models: DataFrame) -> DataFrame:
    """Names of the models whose requests need it: Gemini behind an OpenAI route or with dropped parameters."""
    name = F.coalesce("model_name", F.lit(""))
    target = F.coalesce("litellm_params.model", F.lit(""))
    gemini = F.lower(name).contains("gemini") | F.lower(target).contains("gemini")
    drop = F.coalesce("litellm_params.drop_params", F.lit(False))
    return models.where(gemini & (target.contains("openai/") | drop)).select(name.alias("prefix")).distinct()


def match_model_prefix(
    df: DataFrame, prefixes: DataFrame, model: str = "model", name: str = "matched", in_plan: int = PLAN_PREFIXES
) -> DataFrame:
    """Flag rows whose model starts with a listed prefix; an empty list means every model.

    Up to ``in_plan`` prefixes, as a model configuration has them, become one hash set of literals per length: a row costs one look-up per length,
    with no shuffle and no action on ``df``. A longer list stays a table: the leading substrings of the distinct models, of the lengths that
    occur, are joined to it by equality, and the models found are joined back. The result is the same. A stream takes the list into its plan at any length.
    """
    listed = prefixes.select("prefix").where("prefix IS NOT NULL").distinct()
    known = [row[0] for row in (listed if df.isStreaming else listed.limit(in_plan + 1)).collect()]
    if not known:
        return df.withColumn(name, F.lit(True))
    value = F.coalesce(F.col(model), F.lit(""))
    if len(known) > in_plan and not df.isStreaming:
        return _joined_prefixes(df, listed, value, name)
    by_length: dict[int, list[str]] = {}
    for prefix in sorted(known):
        # Characters as the engine counts them: code points.
        by_length.setdefault(len(prefix), []).append(prefix)
    hits = [F.substring(value, 1, n).isin(found) if n else F.lit(True) for n, found in sorted(by_length.items())]
    hit = hits[0]
    for more in hits[1:]:
        hit = hit | more
    return df.withColumn(name, hit)


def _joined_prefixes(df: DataFrame, listed: DataFrame, value: Column, name: str) -> DataFrame:
    """The match by joins alone. Rows of very frequent models meet a broadcast of theirs (:func:`join_unique`)."""
    # One number per length of a prefix.
    lengths = sorted(row[0] for row in listed.select(F.char_length("prefix")).distinct().collect())
    keyed = df.withColumn("_prefix_model", value)
    models = keyed.select("_prefix_model").distinct()
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("_prefix_model"))
    heads = models.select("_prefix_model", F.explode(fitting).alias("_length"))
    heads = heads.select("_prefix_model", F.expr("substring(_prefix_model, 1, _length)").alias("prefix"))
    found = heads.join(listed, "prefix", "left_semi").select("_prefix_model").distinct().withColumn("_hit", F.lit(True))
    joined = join_unique(keyed, found, ["_prefix_model"])
    columns = df.columns if name in df.columns else [*df.columns, name]
    return joined.withColumn(name, F.coalesce("_hit", F.lit(False))).select(*columns)


def request_model(kwargs: Column) -> Column:
    own = F.get_json_object(kwargs, "$.model")
    inner = F.get_json_object(kwargs, "$.litellm_params.model")
    return F.coalesce(F.nullif(own, F.lit("")), inner, F.lit(""))


def strip_params(kwargs: Column) -> Column:
    """The request arguments without the listed keys of their ``data`` object; other parts are untouched."""
    variants = "MAP<STRING, VARIANT>"
    data = F.get_json_object(kwargs, "$.data")
    kept = F.map_filter(F.from_json(data, variants), lambda k, _: ~k.isin(*SANITIZED_PARAMS))
    rebuilt = F.transform_values(
        F.from_json(kwargs, variants),
        lambda k, v: F.when(k == "data", F.try_parse_json(F.to_json(kept))).otherwise(v),
    )
    return F.when(data.startswith("{"), F.to_json(rebuilt)).otherwise(kwargs)


def sanitize_requests(df: DataFrame, models: DataFrame) -> DataFrame:
    """Raw calls whose ``kwargs`` lost the listed parameters where the model asks for it."""
    named = df.withColumn("_model", request_model(F.col("kwargs")))
    flagged = match_model_prefix(named, sanitize_model_set(models), "_model", "_matched")
    kwargs = F.when(F.col("_matched"), strip_params(F.col("kwargs"))).otherwise(F.col("kwargs"))
    return flagged.withColumn("kwargs", kwargs).drop("_model", "_matched").select(*df.columns)
