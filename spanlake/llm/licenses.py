"""License scans: an Aho-Corasick automaton over the words of each text finds notice phrases and identifier tags; a
shunting-yard parser evaluates the expressions behind the tags. An expression ends at the first token that cannot go on with it.

Defined cases: a null text is empty; a text without words has no match and score 0; overlapping phrases all count;
rows are independent, so repeated rows give repeated results; an empty table gives an empty table; other columns of
the input are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import FOLD, as_bytes, slices

# Phrases as words, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "mit license": "mit",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "boost software license version 1": "bsl-1",
    "eclipse public license version 2": "epl-2",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
}
TAGS = ("spdx license identifier", "license expression")
# Families of identifiers. The longest prefix wins; other identifiers are their own label.
FAMILIES = {
    "apache-2": "apache-2",
    "cc-by-nc": "cc-by-nc",
    "gpl-2": "gpl-2",
    "gpl-3": "gpl-3",
    "lgpl": "lgpl",
    "agpl": "agpl",
    "mpl-2": "mpl-2",
    "cc-by-sa": "cc-by-sa",
    "cc-by-nd": "cc-by-nd",
}
PERMISSIVE = ("mit", "apache-2", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "bsl-1.0", "zlib", "unlicense", "cc0-1.0", "0bsd")

_BINDS = {"or": 1, "and": 2, "with": 3}
_TAG = re.compile(r"(?:spdx\W*license\W*identifier|license\W*expression)[^\S\n]*[:=]?[^\S\n]*[\"']?([^\n\r\"'*#]*)", re.I | re.A)
_TOKEN = re.compile(r"[()]|[^\s()]+")

SCHEMA = (
    "doc_id {}, n_words bigint, matches array<struct<word: bigint, label: string, base: boolean>>, "
    "tags array<struct<expression: string, postfix: string, valid: boolean, permissive: boolean, labels: array<string>>>, "
    "score double"
)


def family(identifier: str) -> str:
    low = identifier.lower().rstrip("+")
    return FAMILIES.get(max((p for p in FAMILIES if low.startswith(p)), key=len, default=""), low)


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order, or None if the expression is malformed.

    ``with`` binds before ``and``, which binds before ``or``; all of them to the left.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in _BINDS:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand_next or not re.fullmatch(r"[A-Za-z0-9.+:-]+", token):
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(rpn: list[str]) -> tuple[bool, list[str]]:
    """Whether the holder may choose only permissive licences, and the labels named. An exception names no licence."""
    stack: list[tuple[bool, set[str]]] = []
    for token in rpn:
        if token not in _BINDS:
            label = family(token)
            stack.append((label in PERMISSIVE, {label}))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(left)
        else:
            free = (left[0] and right[0]) if token == "and" else (left[0] or right[0])
            stack.append((free, left[1] | right[1]))
    return stack[0][0], sorted(stack[0][1])


@lru_cache(maxsize=8)
def _automaton(phrases: tuple[tuple[str, str, str], ...]):
    """Trie with failure links over `` phrase ``; kinds are base, notice and tag."""
    found = ahocorasick.Automaton()
    for phrase, label, kind in phrases:
        key = f" {phrase} ".encode().decode("latin-1")
        found.add_word(key, (found.get(key, ()) + ((len(key), label, kind),)))
    found.make_automaton()
    return found


def leading(text: str) -> str:
    """The expression that a line begins with: it ends where a complete one is followed by anything but an operator, or by a mark."""
    depth, operand_next = 0, True
    for found in _TOKEN.finditer(text):
        token = found[0]
        if token in "()":
            depth += 1 if token == "(" else -1
            operand_next = token == "("
        elif token.lower() in _BINDS:
            operand_next = True
        elif not operand_next and depth <= 0:
            return text[: found.start()].strip()
        else:
            operand_next = False
            bare = token.rstrip(".,;:")
            if bare and bare != token and depth <= 0:
                return text[: found.start() + len(bare)].strip()
    return text.strip()


def _scan(text: bytes, automaton) -> dict:
    words = text.translate(FOLD).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    matches, tagged, begins = [], False, None
    for end, entries in automaton.iter(line):
        for length, label, kind in entries:
            if kind == "tag":
                tagged = True
            else:
                # Where each word begins, made once for a text with matches.
                begins = begins or [0, *accumulate(len(w) + 1 for w in words)]
                matches.append({"word": bisect_left(begins, end - length + 1), "label": label, "base": kind == "base"})
    tags = []
    for found in _TAG.findall(text.decode("utf-8", "replace")) if tagged else ():
        expression = leading(found.partition("-->")[0])
        rpn = postfix(expression)
        free, labels = evaluate(rpn) if rpn else (False, [])
        tags.append({"expression": expression, "postfix": " ".join(rpn or ()), "valid": bool(rpn), "permissive": free, "labels": labels})
    matches.sort(key=lambda m: (m["word"], m["label"], not m["base"]))
    proofs = len(matches) + 2 * sum(t["valid"] for t in tags)
    return {"n_words": len(words), "matches": matches, "tags": tags, "score": 1.0 - 0.5**proofs}


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES
) -> DataFrame:
    """Per row: word count, phrase matches (word position, label), evaluated tags, and a score 1 - 2^-(matches + 2 valid tags)."""
    phrases = tuple((p, label, "base") for p, label in base.items()) + tuple((p, label, "notice") for p, label in notices.items())
    phrases += tuple((t, "", "tag") for t in TAGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(phrases)
        for part in slices(batches, "text"):
            rows = [_scan(t, automaton) for t in as_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([r["n_words"] for r in rows], pa.int64()),
                    pa.array([r["matches"] for r in rows], _MATCHES),
                    pa.array([r["tags"] for r in rows], _TAGS),
                    pa.array([r["score"] for r in rows], pa.float64()),
                ],
                ["doc_id", "n_words", "matches", "tags", "score"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA.format(rows.dtypes[0][1]))


_MATCHES = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))
_TAGS = pa.list_(
    pa.struct(
        [("expression", pa.string()), ("postfix", pa.string()), ("valid", pa.bool_()), ("permissive", pa.bool_()), ("labels", pa.list_(pa.string()))]
    )
)


def license_labels(scan: DataFrame) -> DataFrame:
    """The digest of a scan: counts and first and last place of base phrases, base labels, all labels."""
    base = F.filter("matches", lambda m: m["base"])
    places = F.transform(base, lambda m: m["word"])
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scan.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        join(F.transform(base, lambda m: m["label"])).alias("base_labels"),
        join(
            F.concat(F.transform("matches", lambda m: m["label"]), F.flatten(F.transform("tags", lambda t: t["labels"])))
        ).alias("labels"),
        "score",
        F.size("tags").cast("bigint").alias("n_tags"),
        F.exists("tags", lambda t: t["permissive"]).alias("permissive_tag"),
    )
