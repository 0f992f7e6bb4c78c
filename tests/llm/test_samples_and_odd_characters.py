"""Licence headers, characters that JSON and regular expressions treat apart, and fits on repeated and null ids."""

import json
import random
import time

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from spanlake.llm import languages, licenses, tool_calls, toxicity

from .test_group_operators import MESSAGES, SCHEMAS, call
from .test_text_operators import frame


def scan(text):
    phrases = tuple((p, label, "base") for p, label in licenses.BASE.items()) + tuple((p, label, "notice") for p, label in licenses.NOTICES.items())
    return licenses._scan(text.encode(), licenses._automaton(phrases + tuple((t, "", "tag") for t in licenses.TAGS)))


def test_base_phrases():
    """The base phrase is the whole of it; its last words alone are a notice of the method's own."""
    found = scan("Released under the MIT License. Another MIT-license; Apache License, Version 2.0; CC BY-NC 4.0")
    assert [(m["word"], m["label"]) for m in found["matches"] if m["base"]] == [(1, "mit"), (8, "apache-2"), (13, "cc-by-nc")]
    assert [(m["word"], m["label"]) for m in found["matches"] if not m["base"]] == [(3, "mit"), (6, "mit")]


@pytest.mark.parametrize(
    "line,expression,labels",
    [
        ("// SPDX-License-Identifier: MIT This file is part of it", "MIT", ["mit"]),
        ("# SPDX-License-Identifier: Apache-2.0. Copyright 2020", "Apache-2.0", ["apache-2"]),
        ("<!-- SPDX-License-Identifier: BSD-3-Clause OR GPL-2.0-or-later -->", "BSD-3-Clause OR GPL-2.0-or-later", ["bsd-3-clause", "gpl-2"]),
        ("/* SPDX-License-Identifier: (MIT OR ISC) AND Zlib */", "(MIT OR ISC) AND Zlib", ["isc", "mit", "zlib"]),
        ("; SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note, see COPYING", "GPL-2.0 WITH Linux-syscall-note", ["gpl-2"]),
        ('license-expression = "MIT"', "MIT", ["mit"]),
    ],
)
def test_headers(line, expression, labels):
    (tag,) = scan(line)["tags"]
    assert (tag["expression"], tag["valid"], tag["labels"]) == (expression, True, labels)


def test_scan_takes_linear_time():
    for text in ("mit license " * 83_000, "SPDX-License-Identifier: MIT" + " " * 1_000_000 + "x", "spdx license " * 80_000 + "spdx license identifier: MIT"):
        began = time.process_time()
        scan(text)
        assert time.process_time() - began < 3


def test_json_of_odd_characters(spark):
    """Each line is JSON that reads back to what went in."""
    odd = ["a\u2028b", "\u2029", "x\u0085y", 'say "hi"\\', "two\nlines\r\t", "\x00\x1f", "é\U0001f600", ""]
    rows = [(i, 0, "assistant", t, [call(f"id{t}", "f", json.dumps({"x": 1, "z": t}, ensure_ascii=False)), call(f"bad{t}", f"n{t}", "{" + t)], None, None, 0) for i, t in enumerate(odd)]
    rows += [(i, 1, "tool", t, None, f"id{t}", None, 0) for i, t in enumerate(odd)]
    got = tool_calls.link_calls(spark.createDataFrame(rows, MESSAGES), SCHEMAS).collect()
    assert len(got) == 4 * len(odd)
    for r in got:
        told, text = json.loads(r.json), odd[r.conv_id]
        if r.kind == "call" and r.call_id == f"id{text}":
            assert told == {"arguments": {"x": 1, "z": text}, "id": f"id{text}", "name": "f"} and r.errors == [] and r.linked
        elif r.kind == "call":
            assert told == {"arguments": "{" + text, "id": f"bad{text}", "name": f"n{text}"} and r.errors == ["unknown_tool"]
        else:
            assert told["content"] == text


def test_odd_field_names(spark):
    names = {"a.b": ("integer", True), "it's": ("string", True), 'q"': ("string", False), "a b": ("number", False), "a": ("object", False)}
    good = json.dumps({"a.b": 1, "it's": "x", 'q"': "y", "a b": 1.5, "a": {"b": "no"}})
    bad = json.dumps({"a.b": "1", "a": {"b": 1}, 'q"': 5})
    rows = [(1, 0, "assistant", "", [call("g", "f", good), call("b", "f", bad)], None, None, 0)]
    found = {r.call_id: r.errors for r in tool_calls.link_calls(spark.createDataFrame(rows, MESSAGES), {"f": names}).where("kind = 'call'").collect()}
    assert found == {"g": [], "b": ["type:a.b", "missing:it's", 'type:q"']}


def corpus(n):
    rnd = random.Random(5)
    mild, harsh = ["calm river stone", "green field path", "slow quiet boat"], ["vile grubby scum", "rotten filthy oaf"]
    return [(i, " ".join(rnd.choices(mild, k=6)) + (" " + rnd.choice(harsh) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(n)]


def test_bound_of_the_toxicity_fit(spark):
    """One id with very many rows, and ids that are null, do not raise the number of rows of the fit."""
    rows = corpus(60)
    docs = [(i, t) for i, t, _ in rows] + [(0, f"{rows[0][1]} {k}") for k in range(300)] + [(1, rows[1][1])] * 300 + [(None, "nobody")] * 50
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2 + [(None, 1)], "doc_id bigint, toxic int")
    assert toxicity.training_rows(docs, labels, 40).count() == 40
    whole = toxicity.training_rows(docs, labels, 10_000).collect()
    kept = [i for i, _, _ in rows if not spark.range(1).select(toxicity.held_out(F.lit(i))).first()[0]]
    assert len(whole) == len(kept) + (300 if 0 in kept else 0)


def test_toxicity_against_a_plain_version(spark):
    """Counts, ratios and scores of the fit against sets of n-grams in plain Python."""
    rows = corpus(240)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(5)
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    import zlib

    sample = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    sets = []
    for text, label in sample:
        _, slots = toxicity._grams([text.encode()])
        sets.append((set(slots.tolist()), label))
    n = np.array([sum(y == k for _, y in sets) for k in (0, 1)])
    df = np.zeros((2, len(model.number)))
    for grams, label in sets:
        df[label, list(grams)] += 1
    share, both = df / n[:, None], df.sum(0) / n.sum()
    tells = np.where(df.sum(0) >= 3, np.abs(share[1] - share[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n[0] + 1 / n[1])), 0)
    assert set(np.flatnonzero(model.number >= 0)) == set(np.flatnonzero(tells > 4))
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    for i, text, label in rows:
        _, slots = toxicity._grams([text.encode()])
        z = model.bias + sum(model.weight[model.number[s]] for s in set(slots.tolist()) if model.number[s] >= 0)
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 1e-9 and (got[i] >= toxicity.THRESHOLD) == bool(label)


WORDS = {"aa": ["lumi", "talo", "joki", "suuri"], "bb": ["haus", "berg", "fluss", "gross"], "cc": ["casa", "monte", "fiume", "grande"]}


def sentences(lang, n, seed):
    rnd = random.Random(f"{lang}{seed}")
    return [" ".join(rnd.choices(WORDS[lang], k=12)) for _ in range(n)]


def test_languages_with_repeated_and_null_ids(spark):
    """Rows of null ids have dictionaries, and copies of one row do not flood them."""
    rows = [(None, t, "aa") for t in sentences("aa", 400, 1)] + [(7, t, "bb") for t in sentences("bb", 400, 1)] + [(9, sentences("cc", 1, 1)[0], "cc")] * 3000
    rows += [(i, t, "cc") for i, t in enumerate(sentences("cc", 40, 2))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    found = dict(languages.fit(df, rows=50))
    assert set(found) == set(WORDS) and all(500 < len(d) < 20_000 for d in found.values())
    assert len(found["cc"].split()) <= 12 * 41
    told = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang in WORDS for t in sentences(lang, 20, 3))]
    fresh = spark.createDataFrame(told, "doc_id bigint, text string, want string")
    got = {r.doc_id: r.lang_pred for r in languages.identify(fresh, tuple(sorted(found.items()))).collect()}
    assert all(got[i] == want for i, _, want in told)


def test_languages_against_a_plain_loop(spark):
    dictionaries = tuple((lang, " ".join(sentences(lang, 30, 4)).encode()) for lang in WORDS)
    texts = [t for lang in WORDS for t in sentences(lang, 5, 6)] + ["LUMI haus 123 casa " * 900, "", None, "42 !!", "Ω"]
    got = languages.identify(frame(spark, texts), dictionaries).collect()
    for r in got:
        letters = " ".join(languages._LETTERS.findall((texts[r.doc_id] or "").lower())).encode()
        if not letters:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sizes = {}
        for lang, content in dictionaries:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(level=languages.LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(packer.compress(letters[k : k + languages.BLOCK_BYTES])) for k in range(0, len(letters), languages.BLOCK_BYTES))
        first, second = sorted(sizes, key=lambda lang: (sizes[lang], lang))[:2]
        assert r.lang_pred == first and abs(r.score - (1 - sizes[first] / sizes[second])) < 1e-9
