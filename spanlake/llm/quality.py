"""Quality rules: a table of thresholds, compiled into one Spark projection of built-in functions.

A rule bounds the ratio of two counts of a text. ``judge`` computes each count once, binds them by a lambda (so that no
rule evaluates the text again), and lists the rules that a text breaks. Ratios are compared as products of whole numbers.

Counts of a text: ``n_words`` (runs of anything but the six ASCII blanks), ``word_chars`` (code points in words), ``n_symbols`` (characters of
``SYMBOLS``), ``n_stop_words`` (runs between blanks and ``MARKS`` that are stop words once case is folded), ``n_letter_words`` (words with
a letter), ``n_lines`` (lines with a word), ``n_dup_lines`` (of these, equal to an earlier one), ``n_bullet_lines``, ``n_ellipsis_lines``, and ``n_repeat_words`` (words
inside runs of ``WINDOW`` words that occur twice or more, the first occurrence included).

The base test stands apart from the table: fewer than 20 words, or more than 30 % of the words repeated, fail a text at once.

Defined cases: a null text has no words, so it fails the base test, and so does an empty one; a ratio whose lower count is 0 breaks no rule; equal
rows get equal results; an empty table gives an empty table; other columns of the input are not read, so their names do not matter; texts of
any length are one row, whose work grows with its length (n log n where runs repeat).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Marks between which stop words are looked for, as a set of a regular expression.
MARKS = r"""\x20\x09-\x0D.,;:!?"'()\[\]{}«»“”„’¿¡…-"""
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with as be by this are at from".split(),
    "de": "der die und in den von zu das mit sich des für auf ist im nicht dem ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas avec".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo".split(),
}


@dataclass(frozen=True)
class Rule:
    """A text breaks the rule if ``part / whole`` is below ``least`` or above ``most`` (both in thousandths)."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None


#: The threshold table.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2_000, 16_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("letter_words", "n_letter_words", "n_words", 700, None),
    Rule("same_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 300),
)
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_stop_words",
    "n_letter_words",
    "n_lines",
    "n_dup_lines",
    "n_bullet_lines",
    "n_ellipsis_lines",
    "n_repeat_words",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _n(array: Column) -> Column:
    return F.size(array).cast("bigint")


def _covered(starts: Column) -> Column:
    """Words covered by windows that begin at ``starts`` (ascending)."""
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(-WINDOW).cast("bigint").alias("last"))

    def add(done: Column, start: Column) -> Column:
        return F.struct((done["total"] + F.least(start - done["last"], F.lit(WINDOW))).alias("total"), start.alias("last"))

    return F.aggregate(starts, zero, add, lambda done: done["total"])


def _paired(step: int) -> Callable[[Column], Column]:
    return lambda codes: F.transform(codes, lambda x, k: F.xxhash64(x, F.get(codes, k + step)))


def _repeated(words: Column) -> Column:
    """Words inside repeated windows. Only a text that has one at all sorts its windows."""
    places = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    codes = F.transform(words, lambda w: F.xxhash64(w))
    # Codes of runs of 2, 4 and 8 words. Runs that differ in their codes differ; the others are compared word by word.
    for step in (1, 2, 4):
        codes = let(codes, _paired(step))
    codes = F.slice(codes, F.lit(1), F.size(words) - (WINDOW - 1))
    windows = F.sort_array(F.transform(places, lambda i: F.struct(F.slice(words, i, F.lit(WINDOW)).alias("run"), i.cast("bigint").alias("at"))))

    def starts(runs: Column) -> Column:
        def again(x: Column, k: Column) -> Column:
            before = (k > 0) & (F.get(runs, k - 1)["run"] == x["run"])
            return before | (F.get(runs, k + 1)["run"] == x["run"])

        return F.sort_array(F.transform(F.filter(runs, again), lambda x: x["at"]))

    count = let(codes, lambda c: F.when(F.size(F.array_distinct(c)) < F.size(c), let(windows, lambda runs: _covered(starts(runs)))))
    return F.coalesce(F.when(F.size(words) >= WINDOW, count), F.lit(0).cast("bigint"))


def counts(text: Column, stop_words: Sequence[str]) -> Column:
    """All ``COUNTS`` of a text as one struct."""
    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.translate(body, " \t\n\x0b\x0c\r", "")
    symbols = F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))

    stops = F.filter(F.split(F.lower(body), f"[{MARKS}]+"), lambda x: x.isin(sorted(set(stop_words))))

    def of_words(w: Column) -> list[Column]:
        return [_n(w), F.char_length(bare).cast("bigint"), symbols.cast("bigint"), _n(stops), _n(F.filter(w, lambda x: x.rlike(r"\p{L}")))]

    def of_lines(x: Column) -> list[Column]:
        bullets = F.filter(x, lambda line: line.rlike(r"^[\x20\x09-\x0D]*[-*•]"))
        open_ends = F.filter(x, lambda line: line.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z"))
        return [_n(x), _n(x) - _n(F.array_distinct(x)), _n(bullets), _n(open_ends)]

    def named(columns: list[Column]) -> Column:
        return F.struct(*[c.alias(name) for c, name in zip(columns, COUNTS, strict=True)])

    return let(words, lambda w: let(lines, lambda x: named([*of_words(w), *of_lines(x), _repeated(w)])))


def base_failed(found: Column) -> Column:
    return (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])


def broken(found: Column, rules: Sequence[Rule]) -> Column:
    """Names of the broken rules, in the order of the table."""

    def breaks(rule: Rule) -> Column:
        part, whole = 1000 * found[rule.part], found[rule.whole]
        low = F.lit(False) if rule.least is None else part < rule.least * whole
        high = F.lit(False) if rule.most is None else part > rule.most * whole
        return F.when((whole > 0) & (low | high), F.lit(rule.name))

    return F.array_compact(F.array(*[breaks(rule) for rule in rules])) if rules else F.array().cast("array<string>")


def judge(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    stop_words: Sequence[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row the ``COUNTS``, ``base_failed``, ``broken`` (names of broken rules) and ``kept``."""
    words = [w for some in STOP_WORDS.values() for w in some] if stop_words is None else stop_words

    def verdict(found: Column) -> Column:
        return let(broken(found, rules), lambda names: F.struct(
            *[found[c].alias(c) for c in COUNTS],
            base_failed(found).alias("base_failed"),
            names.alias("broken"),
            (~base_failed(found) & (F.size(names) == 0)).alias("kept"),
        ))

    judged = docs.select(F.col(id_col).alias("doc_id"), let(counts(F.col(text_col), words), verdict).alias("found"))
    return judged.select("doc_id", "found.*")


def _sql_ratio(rule: Rule) -> str:
    sides = [f"1000 * {rule.part} < {rule.least} * {rule.whole}"] if rule.least is not None else []
    sides += [f"1000 * {rule.part} > {rule.most} * {rule.whole}"] if rule.most is not None else []
    return f"CASE WHEN {rule.whole} > 0 AND ({' OR '.join(sides)}) THEN '{rule.name}' END"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_STOPS = ", ".join(f"'{w}'" for w in sorted({w for some in STOP_WORDS.values() for w in some}))
SQL = rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, r, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
runs AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS run
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM parts WHERE len(w) >= {WINDOW})),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS place FROM again) GROUP BY r),
counts AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split_regex(lower(text), '[{_quoted(MARKS)}]+'), lambda x: x IN ({_STOPS}))) AS BIGINT) AS n_stop_words,
  CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_letter_words,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
  CAST(len(list_filter(l, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS BIGINT) AS n_ellipsis_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM parts LEFT JOIN covered c USING (r)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  concat_ws(',', {", ".join(_sql_ratio(r) for r in RULES)}) AS broken FROM counts)
SELECT *, NOT base_failed AND broken = '' AS kept FROM judged
"""
