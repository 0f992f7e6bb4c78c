"""Spelling variants by composition of finite-state machines: vocabulary acceptor, one-edit transducer, vocabulary acceptor.

Two words are near if one code point is inserted, deleted or replaced. Each pair is a path of the composed machine: both words are read alike
from the initial state on, then one edit is made, then both are read alike to the final state. The edit is put at the first place
where the words differ, so each pair has one path.

The whole machine would hold the vocabulary in one task, so it is cut at initial states. Words are classed by the length ``m`` of the shorter word
of a pair (a word of ``k`` code points is in the classes ``k`` and ``k - 1``). A pair is equal in its first ``m // 2`` code points, or in its last ``m - m // 2``.
So the state after each first half is the initial state of one partition, and the state after each last half, read backwards, of another. A partition
builds the minimised acceptors of what its words still hold, composes them with the edit, and enumerates the pairs that both accept. Backward
partitions leave out pairs with equal first halves. Partitions are rows of one shuffle, one partition of words at a time.

A partition of more than ``GROUP_CHARS`` code points, or of words longer than ``LONG``, is not built in one task: there the state after the edit is the key. Each word gives a row for each place,
keyed by what is left without it, so that a key has at most one word per letter; candidates are checked by their distance.

Defined cases: null texts and empty texts have no words; words are counted over all rows, repeated rows and rows with null ids included; equal counts go to the word that
is first in code-point order; an empty vocabulary gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path
from .text import mix, powers, prefix_hash

LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is at least as many times as frequent as its variant.
RATIO = 5
#: Code points of one partition's words; larger ones go by keys.
GROUP_CHARS = 1 << 19
LONG = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(text: Column) -> Column:
    """Runs of letters of a text; only A-Z are lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(f"({LETTERS})"), F.lit(1))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word`` and ``n`` of the rows of ``words`` (one per occurrence) that are long and frequent enough."""
    long_enough = words.where(F.char_length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Machine:
    """Minimised acyclic acceptors of words of one length each, with their states in common. State 0 ends a word."""

    def __init__(self) -> None:
        self.edges: list[dict[str, int]] = [{}]
        self._known: dict[tuple, int] = {(): 0}
        self._meets: dict[tuple[int, int], list[str]] = {}
        self._changes: dict[int, list[tuple[str, str]]] = {}

    def add(self, words: list[str]) -> int:
        """Initial state of the acceptor of ``words``, which are sorted, distinct and of one length."""
        size = len(words[0])
        path: list[dict[str, int]] = [{} for _ in range(size + 1)]
        last = words[0]
        for word in [*words[1:], None]:
            same = 0
            while word is not None and word[same] == last[same]:
                same += 1
            # States below the first letter that differs are complete: equal ones become one.
            for depth in range(size, same if word is not None else -1, -1):
                state = self._state(path[depth])
                path[depth] = {}
                if depth:
                    path[depth - 1][last[depth - 1]] = state
            last = word
        return state

    def _state(self, edges: dict[str, int]) -> int:
        key = tuple(edges.items())
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.edges)
            self.edges.append(edges)
        return state

    def meet(self, p: int, q: int) -> list[str]:
        """All words that both states accept."""
        if p == 0 or q == 0:
            return [""] if p == q else []
        key = (p, q) if p < q else (q, p)
        found = self._meets.get(key)
        if found is None:
            few, many = sorted((self.edges[p], self.edges[q]), key=len)
            found = [c + rest for c, to in few.items() if c in many for rest in self.meet(to, many[c])]
            self._meets[key] = found
        return found

    def replaced(self, p: int) -> list[tuple[str, str]]:
        """Pairs of words from ``p`` on that differ in their first letter alone."""
        found = self._changes.get(p)
        if found is None:
            steps = list(self.edges[p].items())
            found = [(c + r, d + r) for i, (c, to) in enumerate(steps) for d, other in steps[i + 1 :] for r in self.meet(to, other)]
            self._changes[p] = found
        return found

    def inserted(self, p: int, q: int) -> list[tuple[str, str]]:
        """Pairs of a word from ``p`` on and one from ``q`` on that has one more letter, at its start."""
        return [(r, c + r) for c, to in self.edges[q].items() for r in self.meet(p, to) if not r or r[0] != c]


def near_words(short: list[str], long: list[str]) -> Iterator[tuple[str, str]]:
    """Near pairs of distinct words: two of ``short``, or one of ``short`` and one of ``long``, whose words have one letter more."""
    if not short:
        return
    machine = Machine()
    stack: list[tuple[str, int, int | None]] = [("", machine.add(sorted(short)), machine.add(sorted(long)) if long else None)]
    while stack:
        read, p, q = stack.pop()
        for a, b in machine.replaced(p):
            yield read + a, read + b
        if q is not None:
            for a, b in machine.inserted(p, q):
                yield read + a, read + b
        for c, to in machine.edges[p].items():
            stack.append((read + c, to, None if q is None else machine.edges[q].get(c)))


def partitions(vocab: DataFrame) -> DataFrame:
    """Each word in its partitions: ``forward``, ``m``, ``half``, whether it is the longer word, ``word`` and ``n``."""
    size = F.char_length("word")

    def row(forward: bool, longer: bool) -> Column:
        m = size - 1 if longer else size
        first = F.floor(m / 2).cast("int")
        half = F.substring("word", F.lit(1), first) if forward else F.expr("word").substr(size - (m - first) + 1, m - first)
        return F.struct(F.lit(forward).alias("forward"), m.alias("m"), half.alias("half"), F.lit(longer).alias("longer"))

    rows = vocab.select("word", "n", F.explode(F.array(*[row(f, x) for f in (True, False) for x in (True, False)])).alias("at"))
    return rows.select("at.*", "word", "n").where("m > 0")


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, of runs of rows with one partition each."""
    now, words, out = None, {}, []

    def flush() -> None:
        if len(words) < 2:
            return
        forward, m, half = now
        cut = m // 2
        # What is left of each word, read away from the half that all words share.
        rest = {(w[len(half) :] if forward else w[: len(w) - len(half)][::-1]): w for w in words}
        for a, b in near_words([r for r, w in rest.items() if len(w) == m], [r for r, w in rest.items() if len(w) > m]):
            a, b = rest[a], rest[b]
            if forward or a[:cut] != b[:cut]:
                out.append((a, b, words[b]))
                out.append((b, a, words[a]))

    def table() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [(), (), ()]
        made = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))]
        out.clear()
        return pa.RecordBatch.from_arrays(made, ["word", "other", "other_n"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("forward", "m", "half", "word", "n")]
        for forward, m, half, word, n in zip(*columns):
            if (forward, m, half) != now:
                flush()
                now, words = (forward, m, half), {}
            words[word] = n
            if len(out) >= 1 << 14:
                yield table()
        yield table()
    flush()
    yield table()


def _deletions(word: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Letters of a word, codes of the word without each of them, and the code of the whole word."""
    letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    c = prefix_hash(letters)
    back = powers(2, inverse=True)[1]
    return letters, c[:-1] + (c[-1] - c[1:]) * back, int(c[-1])


def _edit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the states after an edit: of a replaced letter at each place, or of a letter that only the longer word has."""
    for batch in batches:
        for k, (word, longer) in enumerate(zip(batch.column("word").to_pylist(), batch.column("longer").to_pylist())):
            letters, without, whole = _deletions(word)
            if longer:
                # Of a run of equal letters, the last.
                keys = without[np.append(letters[1:] != letters[:-1], True)]
            else:
                place = np.arange(1, len(word) + 1, dtype=np.uint64)
                keys = np.append(mix(without + mix(place)), np.uint64(whole))
            n = len(keys)
            replaced = np.zeros(n, bool)
            replaced[: 0 if longer else n - 1] = True
            same = [pa.array([batch.column(c)[k].as_py()] * n, batch.schema.field(c).type) for c in ("part", "id", "longer")]
            for at in range(0, n, 1 << 14):
                here = slice(at, at + (1 << 14))
                yield pa.RecordBatch.from_arrays(
                    [*[x[here] for x in same], pa.array(keys[here].view(np.int64)), pa.array(replaced[here])], ["part", "id", "longer", "key", "replaced"]
                )


def _keyed_pairs(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Near pairs, both ways, of partitions too large or with words too long for one acceptor."""
    part = F.xxhash64("forward", "m", "half").alias("part")
    schema = "part bigint, id bigint, longer boolean, key bigint, replaced boolean"
    keys = rows.select(part, F.xxhash64("word").alias("id"), "longer", "word").mapInArrow(_edit_keys, schema)
    left = keys.where("NOT longer")
    right = keys.toDF("part", "b", "b_longer", "key", "replaced")
    other = F.when(F.col("replaced"), F.col("id") < F.col("b")).otherwise(F.col("b_longer"))
    ids = left.join(right, ["part", "key", "replaced"]).where(other).select("id", "b").distinct()
    named = vocab.select(F.xxhash64("word").alias("id"), "word", "n")
    pairs = ids.join(named, "id").join(named.toDF("b", "other", "other_n"), "b").where(F.levenshtein("word", "other", 1) == 1)
    return pairs.select("word", "other", "other_n").unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def near_pairs(vocab: DataFrame, group_chars: int = GROUP_CHARS, long: int = LONG) -> DataFrame:
    """``word``, ``other`` and ``other_n`` of every near pair of the words of ``vocab`` (word, n), both ways."""
    rows, names = partitions(vocab), ["forward", "m", "half"]
    sized = rows.groupBy(*names).agg(F.count("*").alias("words"), F.bool_or(~F.col("longer")).alias("short"), F.sum(F.char_length("word")).alias("chars"))
    sized = _saved(sized.where("words > 1 AND short").select(*names, "chars"), "spelling-partitions")
    heavy = sized.where((F.col("chars") > group_chars) | (F.col("m") > long)).drop("chars")
    light = sized.where((F.col("chars") <= group_chars) & (F.col("m") <= long)).drop("chars")
    grouped = rows.join(light, names, "left_semi").repartition(*names).sortWithinPartitions(*names)
    found = grouped.select(*names, "word", "n").mapInArrow(_enumerate, "word string, other string, other_n bigint")
    if heavy.isEmpty():
        return found
    keyed = _keyed_pairs(rows.join(heavy, names, "left_semi"), vocab)
    # The same pair can be in a light partition one way and in a heavy one the other.
    return found.unionByName(keyed).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """Last form of each ``word``. Counts grow at each step, so there is no circle, and few rounds of doubled steps suffice."""
    now = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).checkpoint()
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def group_variants(vocab: DataFrame, ratio: int = RATIO, group_chars: int = GROUP_CHARS, long: int = LONG) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of each row of ``vocab`` (word, n)."""
    vocab = _saved(vocab.select("word", F.col("n").cast("bigint").alias("n")), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = near_pairs(vocab, group_chars, long).groupBy("word").agg(F.count("*").alias("n_near"), best)
    whole = vocab.join(near, "word", "left")
    there = -F.col("best.less") >= ratio * F.col("n")
    whole = whole.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(there, F.col("best.other")).alias("form"),
        F.when(there, -F.col("best.less")).alias("form_n"),
    )
    whole = _saved(whole, "spelling-forms")
    roots = _roots(whole.where("form IS NOT NULL"))
    return whole.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def damaged_words(docs: DataFrame) -> DataFrame:
    """Letter runs of all texts, of which about one in 199 loses a code point, as the checksum of id and run tells."""
    runs = docs.select("doc_id", F.explode(letter_runs(F.col("text"))).alias("run"))
    sum_ = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", sum_.alias("h"), F.pmod(sum_, F.char_length("run")).cast("int").alias("at"))
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    return runs.select(F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("run")).alias("word"))


SQL = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
crc AS (SELECT list(c ORDER BY b) AS c FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) t(b))),
coded AS (SELECT run, n, hex(encode(doc_id || ':' || run)) AS code FROM runs),
summed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(code) // 2),
    lambda i: CAST(16 * instr('0123456789ABCDEF', code[2 * i + 1]) + instr('0123456789ABCDEF', code[2 * i + 2]) - 17 AS BIGINT))),
    lambda x, y: xor(x >> 8, c[xor(x & 255, y) + 1]))) AS h FROM coded, crc),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM summed) GROUP BY word HAVING length(word) >= {MIN_LENGTH} AND sum(n) >= {MIN_COUNT}),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM vocab)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word AND length(a.word) = length(b.word)
    UNION SELECT c.word, v.word, v.n FROM cuts c JOIN vocab v ON v.word = c.cut UNION SELECT v.word, c.word, c.n FROM cuts c JOIN vocab v ON v.word = c.cut),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
forms AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n
    FROM vocab v LEFT JOIN near USING (word)),
steps AS (SELECT word, word AS last, 0 AS depth FROM forms UNION ALL SELECT s.word, f.form, s.depth + 1 FROM steps s JOIN forms f ON f.word = s.last WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(last, depth) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
