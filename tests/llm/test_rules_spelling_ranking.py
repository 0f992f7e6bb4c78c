"""Quality rules, spelling variants and ranked search: against brute force and on odd rows."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spanlake.llm import quality, ranking, spelling

from .conftest import ODD_TEXTS


def blank_split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute_quality(text):
    text = text or ""
    w = blank_split(text)
    lines = [x for x in text.split("\n") if blank_split(x)]
    runs = collections.defaultdict(list)
    for i in range(len(w) - 7):
        runs[tuple(w[i : i + 8])].append(i)
    covered = {p for at in runs.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in quality.SYMBOLS for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def test_quality_counts(spark):
    rnd = random.Random(0)
    texts = [t for _, t in ODD_TEXTS]
    for _ in range(60):
        vocab = rnd.choice([["a", "b"], list("abcdefghij"), ["the", "wörd", "#tag", "x|y", "$", "…", "é é"]])
        texts.append("".join(rnd.choice(vocab) + rnd.choice(" \t\n\r\x0b ") for _ in range(rnd.randint(0, 90))))
    texts += ["one two three four five six seven eight " * 3, "a " * 8, "a " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        want = brute_quality(text)
        assert {k: found[i][k] for k in want} == want, text
        base = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert found[i].base_failed == base and found[i].kept == (not base and not found[i].broken)


def test_quality_rules(spark, odd):
    good = "The house of the rising sun is on a hill and it was old. " + " ".join(f"word{chr(97 + i)}x" for i in range(20))
    cases = {
        "": good,
        "symbols": good.replace(" ", " # "),
        "stop_words": " ".join(f"kanu{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)),
        "letter_words": good + " 12" * 1 + " ".join(str(i) for i in range(90)),
        "same_lines": good + "\nsame line" * 7,
        "bullet_lines": "\n".join(f"- {w}" for w in good.split()),
        "ellipsis_lines": "\n".join(f"{w} ..." for w in good.split()),
        "word_length": " ".join("the" + "x" * 40 + str(i) for i in range(25)) + " the",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "doc_id string, text string")
    for r in quality.judge(df).collect():
        assert (r.doc_id in r.broken) if r.doc_id else (r.broken == [] and r.kept), r
    assert quality.judge(df, rules=()).where("kept").count() == quality.judge(df).where("NOT base_failed").count()
    assert quality.judge(odd).count() == len(ODD_TEXTS) and quality.judge(odd.limit(0)).count() == 0
    plan = quality.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan.replace("Exchange RoundRobin", "")


def edits(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(vocab):
    near = {w: sorted((x for x in vocab if edits(w, x)), key=lambda x: (-vocab[x], x)) for w in vocab}
    form = {w: next((x for x in near[w][:1] if vocab[x] >= 5 * vocab[w]), None) for w in vocab}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (vocab[w], len(near[w]), form[w], vocab[form[w]] if form[w] else None, root(w)) for w in vocab}


def variants_vocabulary(seed):
    rnd = random.Random(seed)
    vocab, letters = {}, "abé"
    for _ in range(40):
        word = "".join(rnd.choices(letters, k=rnd.randint(6, 9)))
        for _ in range(rnd.randint(1, 8)):
            vocab[word] = 5 ** rnd.randint(1, 7)
            i, c = rnd.randrange(len(word)), rnd.choice(letters)
            word = rnd.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]])
    vocab = {w: n for w, n in vocab.items() if len(w) >= 6}
    vocab |= {"x" * 300: 7, "x" * 301: 70, "x" * 150 + "y" + "x" * 149: 700}
    return vocab


@pytest.mark.parametrize("group_chars", [spelling.GROUP_CHARS, 60, 0])
def test_variants(spark, group_chars):
    """With whole partitions, with some that are too large, and with keys alone."""
    vocab = variants_vocabulary(group_chars)
    df = spark.createDataFrame(list(vocab.items()), "word string, n bigint")
    found = spelling.group_variants(df, group_chars=group_chars).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == brute_variants(vocab) and len(found) == len(vocab)


def test_minimised():
    machine = spelling.Machine()
    state = machine.add(sorted(["tapes", "taped", "tamed", "tames", "gamed", "games"]))
    assert sorted(machine.meet(state, state)) == ["gamed", "games", "tamed", "tames", "taped", "tapes"]
    # One state for each of: the end, s or d, e, "m", "m or p", a (twice), the start.
    assert len(machine.edges) == 8


def test_vocabulary_of_odd_rows(spark, odd):
    words = [r.word for r in spelling.vocabulary(odd.select(F.explode(spelling.letter_runs(F.col("text"))).alias("word")), 4, 2).collect()]
    assert sorted(words) == ["line", "plain", "short", "word", "words"]
    none = spelling.group_variants(spelling.vocabulary(spelling.damaged_words(odd.limit(0))))
    assert none.columns == ["word", "n", "n_near", "form", "form_n", "root"] and none.count() == 0


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_rank(docs, items, k):
    docs = [(i, collections.Counter(terms(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = {}
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out[item] = [(None if none else i, -s) for s, none, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("seed_docs,item_bytes,k", [(4096, 1 << 20, 50), (40, 200, 3)])
def test_rank(spark, odd, seed_docs, item_bytes, k, monkeypatch):
    """Also with many small chunks of documents and of items, and thresholds from a sample."""
    monkeypatch.setattr(ranking, "CHUNK_DOCS", 64)
    rnd = random.Random(k)
    vocab = ["".join(rnd.choices("abcdé9", k=rnd.randint(1, 4))) for _ in range(80)]
    docs = list(ODD_TEXTS) + [(100 + i, " ".join(rnd.choices(vocab, weights=range(1, 81), k=rnd.randint(0, 60)))) for i in range(400)]
    docs += [(600 + i, docs[30][1]) for i in range(70)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 12)))) for i in range(25)] + [(90, None), (91, "!!"), (92, "nowhere"), (93, "WORDS line")]
    frame = odd.unionByName(spark.createDataFrame(docs[len(ODD_TEXTS) :], "doc_id bigint, text string"), allowMissingColumns=True)
    queries = spark.createDataFrame(items, "item_id int, text string").withColumn("score", F.lit(1))
    rows = ranking.rank(frame, queries.unionByName(queries.limit(2)), k, item_bytes, seed_docs).collect()
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.item_id, r["rank"])):
        got[r.item_id].append((r.doc_id, r.score))
        assert r["rank"] == len(got[r.item_id])
    want = brute_rank(docs, items, k)
    assert dict(got) == {i: x for i, x in want.items() if x}


def test_rank_of_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "plain words")], "item_id int, text string")
    assert ranking.rank(odd.limit(0), items).count() == 0
    assert ranking.rank(odd, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
