"""Text and message-list expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MESSAGES = "ARRAY<STRUCT<role: STRING, content: VARIANT, tool_call_id: STRING>>"
PARTS = "ARRAY<STRUCT<type: STRING, text: STRING, image_url: STRUCT<url: STRING>>>"

# Marker after a cut text, and the width kept of an image address.
CUT_MARK = "... (truncated)"
IMAGE_WIDTH = 60


def truncate_text(text: Column, width: int, suffix: str = CUT_MARK) -> Column:
    """The text itself up to ``width`` characters, else its start and a marker."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit(suffix))).otherwise(text)


def parse_messages(messages: Column) -> Column:
    """Message list from its JSON text; content stays a variant because it may be text or parts."""
    return F.from_json(messages, MESSAGES)


def content_text(content: Column) -> Column:
    """A variant content as text: a string as it is, anything else as JSON."""
    return F.try_variant_get(content, "$", "string")


def flatten_content(messages: Column, width: int | None = None) -> Column:
    """``ARRAY<STRUCT<role, content>>`` with part lists turned into lines of text.

    Text parts are kept, image parts become ``[Image: <start of address>...]``, others are left out.
    ``width`` cuts plain string contents the way the call viewer does.
    """

    def one_part(part: Column) -> Column:
        return F.when(part["type"] == "text", F.coalesce(part["text"], F.lit(""))).when(
            part["type"] == "image_url",
            F.concat(
                F.lit("[Image: "),
                F.substring(F.coalesce(part["image_url"]["url"], F.lit("")), 1, IMAGE_WIDTH),
                F.lit("...]"),
            ),
        )

    def one_message(message: Column) -> Column:
        parts = F.try_variant_get(message["content"], "$", PARTS)
        plain = F.coalesce(content_text(message["content"]), F.lit(""))
        if width is not None:
            plain = truncate_text(plain, width)
        return F.struct(
            F.coalesce(message["role"], F.lit("unknown")).alias("role"),
            F.when(parts.isNotNull(), F.array_join(F.transform(parts, one_part), "\n")).otherwise(plain).alias("content"),
        )

    return F.transform(parse_messages(messages), one_message)


def last_content(messages: Column, role: str = "user") -> Column:
    """Content of the last message of a role, read from the messages JSON text."""
    wanted = F.filter(parse_messages(messages), lambda m: m["role"] == role)
    return content_text(F.try_element_at(wanted, F.lit(-1))["content"])
