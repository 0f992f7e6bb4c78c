"""Column-level building blocks."""

from .attributes import ATTRIBUTE_TYPES, attr, attrs_map, attrs_struct, attrs_variant, variant_attr, with_attrs
from .ids import call_ids, with_default_ids
from .texts import content_text, flatten_content, last_content, parse_messages, truncate_text
from .times import duration, iso_duration_ms, normalize_ts, shard_label, to_epoch

__all__ = [
    "ATTRIBUTE_TYPES",
    "attr",
    "attrs_map",
    "attrs_struct",
    "attrs_variant",
    "call_ids",
    "content_text",
    "duration",
    "flatten_content",
    "iso_duration_ms",
    "last_content",
    "normalize_ts",
    "parse_messages",
    "shard_label",
    "to_epoch",
    "truncate_text",
    "variant_attr",
    "with_attrs",
    "with_default_ids",
]
