"""Access to the JSON attribute text of a span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Attribute keys that the capture step writes, with the type each is read as.
ATTRIBUTE_TYPES = {
    "llm.model": "STRING",
    "llm.request.messages": "STRING",
    "llm.request.system": "STRING",
    "llm.request.temperature": "DOUBLE",
    "llm.request.max_tokens": "BIGINT",
    "llm.request.top_p": "DOUBLE",
    "llm.request.tools": "STRING",
    "llm.response.content": "STRING",
    "llm.response.tool_calls": "STRING",
    "llm.response.reasoning": "STRING",
    "llm.usage.prompt_tokens": "BIGINT",
    "llm.usage.completion_tokens": "BIGINT",
    "llm.usage.total_tokens": "BIGINT",
    "llm.provider.token_ids": "STRING",
    "llm.prompt_token_ids": "STRING",
    "llm.conversation.tool_results": "STRING",
    "llm.messages": "STRING",
    "llm.error": "STRING",
}


def attr(attributes: Column, key: str, type_: str = "string") -> Column:
    """One attribute, typed. Bad JSON, a missing key and a value of another type give null."""
    value = F.get_json_object(attributes, f"$['{key}']")
    return value if type_ == "string" else value.try_cast(type_)


def attrs_map(attributes: Column) -> Column:
    """All attributes as ``MAP<STRING, STRING>``; text that is not a JSON object gives an empty map."""
    parsed = F.from_json(attributes, "MAP<STRING, STRING>")
    return F.coalesce(parsed, F.create_map().cast("MAP<STRING, STRING>"))


def attrs_struct(attributes: Column, *keys: str) -> Column:
    """The wanted attributes from one parse, as a struct. Field names keep their dots."""
    wanted = keys or tuple(ATTRIBUTE_TYPES)
    ddl = ", ".join(f"`{key}` {ATTRIBUTE_TYPES[key]}" for key in wanted)
    return F.from_json(attributes, ddl)


def attrs_variant(attributes: Column) -> Column:
    """All attributes as one VARIANT value; text that is not JSON gives an empty object.

    Parquet stores it shredded: keys that most rows of a file have, with one type, become columns of their own, lists included.
    """
    return F.coalesce(F.try_parse_json(attributes), F.parse_json(F.lit("{}")))


def variant_attr(attrs: Column, key: str, type_: str = "string") -> Column:
    """One attribute of a VARIANT column, typed (``array<string>`` for a list). From a shredded file only this key is read."""
    path = f'$["{key}"]' if "'" in key else f"$['{key}']"
    return F.try_variant_get(attrs, path, type_)


def with_attrs(df: DataFrame, **wanted: str) -> DataFrame:
    """Promote attributes to columns: ``with_attrs(df, model="llm.model")``. One parse per row, and none
    for columns that the frame already has, or where it has the attributes as VARIANT (``attrs``)."""
    missing = {name: key for name, key in wanted.items() if name not in df.columns}
    if not missing:
        return df
    if dict(df.dtypes).get("attrs") == "variant":
        return df.withColumns({name: variant_attr(F.col("attrs"), key, ATTRIBUTE_TYPES[key]) for name, key in missing.items()})
    parsed = df.withColumn("_attrs", attrs_struct(F.col("attributes"), *dict.fromkeys(missing.values())))
    columns = {name: F.col("_attrs").getField(key) for name, key in missing.items()}
    return parsed.withColumns(columns).drop("_attrs")
