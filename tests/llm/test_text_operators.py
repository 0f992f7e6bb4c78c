"""License scans, decontamination, pieces, toxicity, languages: against brute force and on odd rows."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from spanlake.llm import decontamination, languages, licenses, pieces, toxicity

from .conftest import ODD_TEXTS

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def frame(spark, texts, name="text"):
    return spark.createDataFrame(list(enumerate(texts)), f"doc_id bigint, {name} string").repartition(3)


def test_expressions():
    assert licenses.postfix("MIT OR Apache-2.0 AND ISC") == ["MIT", "Apache-2.0", "ISC", "and", "or"]
    assert licenses.evaluate(licenses.postfix("(MIT OR GPL-3.0-only) AND ISC")) == (True, ["gpl-3", "isc", "mit"])
    assert licenses.evaluate(licenses.postfix("GPL-2.0-only WITH Classpath-exception-2.0")) == (False, ["gpl-2"])
    for broken in ("", "MIT OR", "AND MIT", "(MIT", "MIT)", "()", "MIT MIT", "MIT (ISC)"):
        assert licenses.postfix(broken) is None


def test_license_scan(spark):
    rnd = random.Random(1)
    parts = ["MIT", "License", "apache license, version 2", "cc by-nc", "CC", "by", "nc", "the", "version", "2", "\n", "SPDX-License-Identifier: MIT OR (\n"]
    texts = [" ".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(150)] + [None, "", "x // SPDX-License-Identifier: ISC AND Zlib\ny"]
    got = {r.doc_id: r for r in licenses.license_labels(licenses.scan_licenses(frame(spark, texts))).collect()}
    for i, text in enumerate(texts):
        w = words(text)
        found = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        row = got[i]
        assert (row.n_words, row.n_base) == (len(w), len(found))
        assert row.first_word == min((k for k, _ in found), default=None)
        assert row.last_word == max((k for k, _ in found), default=None)
        assert row.base_labels == ",".join(sorted({label for _, label in found}))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1
    assert got[152].labels == "isc,zlib" and got[152].permissive_tag


def brute_hits(text, items):
    w = words(text)
    hit, names = set(), set()
    for item, passage in items:
        own = words(passage)
        n = min(13, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == own[k : k + n]:
                    hit.update(range(i, i + n))
                    names.add(str(item))
    return len(w), hit, sorted(names)


@pytest.mark.parametrize("block", [100, 3])
def test_decontamination(spark, block):
    rnd = random.Random(block)
    word = lambda: rnd.choice("aa bb cc dd Ee ff é".split())
    items = [(k, " ".join(word() for _ in range(rnd.choice([0, 1, 4, 13, 14, 20])))) for k in range(9)]
    items += [(3, "zz yy"), (3, "zz yy"), (None, "aa"), (77, None)]
    known = [t for i, t in items if t and i is not None]
    texts = [" - ".join(rnd.choice(known) if rnd.random() < 0.2 else word() for _ in range(rnd.randint(0, 120))) for _ in range(60)] + [None, ""]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.find_items(frame(spark, texts), table, block_items=block)
    spans = {r.doc_id: r for r in found.collect()}
    digest = {r.doc_id: r for r in decontamination.digest(found).collect()}
    clean = [(i, t) for i, t in items if t is not None and i is not None]
    for i, text in enumerate(texts):
        n, hit, names = brute_hits(text, clean)
        assert {k for r in spans[i].hits for k in range(r.first_word, r.end_word)} == hit
        assert spans[i]["items"] == names
        row = digest[i]
        assert (row.n_words, row.n_hit, row.n_items) == (n, len(hit), len(names))
        assert row.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert row.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)


def test_pieces_match_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(2)
    parts = ["a", "b", " ", "  ", "▁", "\n", "é", "漢", "\U0001f600", "\x00", "ing", "the ", " of", "er", "1", "<s>", "\t", "أ"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 60))) for _ in range(2000)]
    texts += ["".join(rnd.choices(["a", "in", "the", "=-", "0", "er"], k=rnd.randint(300, 900))) for _ in range(40)]
    texts += ["a" * 3000, " " * 1000 + "x", " " * 15, "▁" * 77, "ab" * 500 + " " * 31, "", "\n", " ", "0" * 999]
    encoder = pieces.Encoder(pieces.Vocabulary(MODEL))
    flat, bounds = encoder.encode(texts)
    decoded = encoder.vocabulary.decode_all(flat, bounds)
    for k, want in enumerate(model.encode(texts)):
        assert flat[bounds[k] : bounds[k + 1]].tolist() == want, texts[k][:80]
        assert decoded[k] == model.decode(want)
    pool = [0, 1, 2, 3, 200, 0xE2 + 3, 0x28 + 3, 259, 260, 28705, 300]
    for _ in range(1000):
        ids = [rnd.choice([*pool, rnd.randint(0, 31_999)]) for _ in range(rnd.randint(0, 8))]
        assert encoder.vocabulary.decode(ids) == model.decode(ids)
        assert encoder.vocabulary.decode_all(np.array(ids, np.int64), np.array([0, len(ids)])) == [model.decode(ids)]
    got = {r.doc_id: r for r in pieces.digest(pieces.encode_decode(frame(spark, [None, *texts[:50]]), MODEL)).collect()}
    for k, text in enumerate(["", *texts[:50]]):
        ids = model.encode(text) + [2]
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_items_are_held_block_by_block(spark, monkeypatch):
    """Each block is on the driver alone, and what earlier blocks found is kept."""
    held = []
    build = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: held.append(len(value[0])) or build(value))
    items = spark.createDataFrame([(str(k), f"w{k} x{k}") for k in range(40)] * 2, "item_id string, text string")
    texts = [f"a w{k} x{k} b w{k + 1} x{k + 1}" for k in range(38)] + [None, "", "w1"]
    many = decontamination.find_items(frame(spark, texts), items, block_items=20).collect()
    assert len(held) == 4 and sum(held) == 40
    one = decontamination.find_items(frame(spark, texts), items).collect()
    assert held[4:] == [40] and sorted(many) == sorted(one)
    assert sum(len(r["items"]) for r in one) == 76


def test_pieces_forget_words_by_bytes(monkeypatch):
    """Long words without blanks fill the memory soon, and the ids stay the library's."""
    monkeypatch.setattr(pieces, "MEMORY", 200_000)
    rnd = random.Random(5)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = pieces.Encoder(pieces.Vocabulary(MODEL))
    most = 0
    for _ in range(30):
        texts = ["".join(rnd.choices("漢字仮名交文abc", k=300)) for _ in range(40)]
        flat, bounds = encoder.encode(texts)
        assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == model.encode(texts)
        most = max(most, encoder.memory)
    # At most one batch beyond the bound.
    assert most < 400_000
    assert sum(map(len, encoder.number)) * 2 + 4 * len(encoder.ids) < encoder.memory < 400_000


def test_pieces_of_a_very_long_word():
    rnd = random.Random(3)
    text = "".join(rnd.choices("abcdefghijklmnop", k=20_000))
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    flat, _ = pieces.Encoder(pieces.Vocabulary(MODEL)).encode([text])
    assert flat.tolist() == model.encode(text)


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(4)
    bad = ["grumbold", "snarkwort", "vexling"]
    rows = []
    for i in range(1200):
        text = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(rnd.randint(5, 60))]
        toxic = int(rnd.random() < 0.2)
        if toxic:
            text[rnd.randrange(len(text))] = rnd.choice(bad)
        rows.append((i, " ".join(text), toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    return docs.select("doc_id", "text"), docs.select("doc_id", "toxic")


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    scored = toxicity.score_texts(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    right = sum((r.score >= toxicity.THRESHOLD) == (r.toxic == 1) for r in scored)
    assert len(scored) > 200 and right / len(scored) > 0.95


def test_toxicity_rounds_are_small():
    """A numpy round holds n-grams of half a megabyte of text, so that a task needs little memory."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(300)) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"label": pa.array([i % 2 for i in range(1500)], pa.int32()), "text": texts})
    tracemalloc.start()
    found = list(toxicity._frequencies(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1 and peak < 180 << 20, peak >> 20


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([(1, None), (None, 1), (2, 5)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd, none)
    assert [r.score for r in toxicity.score_texts(odd, model).collect()] == [pytest.approx(0.05)] * len(ODD_TEXTS)
    one = toxicity.fit(odd, spark.createDataFrame([(1, 0), (5, 0), (8, 0)], "doc_id bigint, toxic int"))
    assert all(0 < r.score < 0.3 for r in toxicity.score_texts(odd, one).collect())
    assert toxicity.drop_toxic(odd, one).columns == odd.columns
    assert toxicity.drop_toxic(odd, one).count() == len(ODD_TEXTS)


def test_languages_on_other_texts(spark):
    rnd = random.Random(5)
    sounds = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["que", "eau", "oi", "ier"]}
    make = lambda lang: " ".join("".join(rnd.choices(sounds[lang], k=rnd.randint(1, 4))) for _ in range(rnd.randint(20, 80)))
    rows = [(i, make(lang), lang) for i in range(300) for lang in [rnd.choice(list(sounds))]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = languages.fit(docs.where("doc_id < 150"))
    got = languages.identify(docs.where("doc_id >= 150"), found).join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    odd = languages.identify(frame(spark, [None, "", "12 !!", make("cc")]), found).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd] == ["und", "und", "und", "cc"] and [r.score for r in odd[:3]] == [0, 0, 0]
    assert [r.lang_pred for r in languages.identify(frame(spark, ["abc"]), ()).collect()] == ["und"]
    assert languages.fit(docs.where("false")) == ()


def test_odd_rows(spark, odd):
    n = len(ODD_TEXTS)
    scan = licenses.license_labels(licenses.scan_licenses(odd))
    assert scan.count() == n and scan.where("doc_id = 5").first().n_words == 40_000
    items = spark.createDataFrame([(1, "plain words in a short line")], "item_id bigint, text string")
    found = decontamination.find_items(odd.select("doc_id", "text", "score"), items)
    assert sorted(r.doc_id for r in found.where("size(items) > 0").collect()) == [1, 6, 6]
    kept = decontamination.decontaminate(odd, items)
    assert kept.columns == odd.columns and kept.count() == n - 3
    with pytest.raises(ValueError):
        decontamination.find_items(odd, items, keep=("doc_id", "hits"))
    encoded = pieces.encode_decode(odd, MODEL)
    texts = sorted((r.decoded, r.doc_id or -1) for r in encoded.collect())
    assert texts == sorted((t or "", i or -1) for i, t in ODD_TEXTS)
    assert languages.identify(odd, languages.fit(odd)).count() == n


def test_empty_tables(spark, odd):
    none = odd.where("false")
    items = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert licenses.scan_licenses(none).count() == 0
    assert decontamination.digest(decontamination.find_items(none, items)).count() == 0
    assert decontamination.find_items(odd, items).where("size(items) > 0").count() == 0
    assert pieces.encode_decode(none, MODEL).count() == 0
    assert toxicity.score_texts(none, toxicity.fit(none, labels)).count() == 0
    assert languages.identify(none, languages.fit(none)).count() == 0
