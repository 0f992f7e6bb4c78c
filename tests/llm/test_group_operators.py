"""Sharding, near duplicates, repeats, neighbours, tool calls and the pipeline: against brute force and on odd rows."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanlake.llm import near_dedup, neighbours, repeats, sharding, tool_calls
from spanlake.llm.components import connected_components
from spanlake.llm.text import split_words

from .conftest import ODD_TEXTS
from .test_text_operators import frame, words


def test_near_duplicate_rounds_are_small():
    """A numpy round holds the darts of half a megabyte of text, so that a task needs little memory."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(300)) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1500)), "node": pa.array([b"n"] * 1500, pa.binary()), "text": texts})
    tracemalloc.start()
    keyed = near_dedup._keys(False, near_dedup.BANDS, near_dedup.ROWS, near_dedup.KEY_BYTES)
    rows = sum(part.num_rows for part in keyed(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1500 and peak < 100 << 20


def test_schedule_is_least_loaded_first():
    rnd = random.Random(0)
    sizes = [rnd.randint(9, 2000) for _ in range(300)]
    want = [0] * 5
    for size in sorted(sizes, reverse=True):
        want[want.index(min(want))] += size
    counts = collections.Counter(sizes)
    plan = sharding.schedule([(s, n, float(s)) for s, n in counts.items()], 5)
    got = [sum(size * given[k] for size, given in plan) for k in range(5)]
    assert sorted(got) == sorted(want)
    bulk = sharding.schedule([(1000, 3, 1000.0), (10, 1_000_003, 10.0)], 7)
    loads = [sum(size * given[k] for size, given in bulk) for k in range(7)]
    assert sum(bulk[1][1]) == 1_000_003 and max(loads) - min(loads) <= 10


def test_shards(spark):
    rnd = random.Random(1)
    base = ["".join(rnd.choices("abc é", k=rnd.choice([3, 50, 400, 5000]))) for _ in range(200)]
    texts = [rnd.choice(base) for _ in range(500)] + ["hot"] * 300 + [None, None, ""]
    rows = sharding.assign_shards(frame(spark, texts), 7).collect()
    assert len(rows) == len(texts)
    where, load, slots = {}, collections.Counter(), collections.defaultdict(list)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r["size"] == len(text.encode()) + 8 and r.text_crc32 == __import__("zlib").crc32(text.encode())
        assert where.setdefault(text, r.shard) == r.shard
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(load) == set(range(7)) and max(load.values()) - min(load.values()) <= max(map(len, base)) * 5


def test_darts_estimate_weighted_similarity():
    rnd = np.random.default_rng(0)
    code = rnd.integers(1, 1 << 60, 60).astype(np.uint64)
    a, b = rnd.random(60) * 3, rnd.random(60) * 3
    text = np.repeat([0, 1], 60)
    weight = np.concatenate((a, b))
    sig, there = near_dedup.signatures(text, np.concatenate((code, code)), weight, 3, k=4000)
    assert there.tolist() == [True, True, False]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicates(spark):
    rnd = random.Random(2)
    vocab = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = []
    for _ in range(12):
        hub = rnd.choices(vocab, k=rnd.randint(60, 200))
        texts.append(" ".join(hub))
        for _ in range(rnd.randint(0, 12)):
            other = list(hub)
            for _ in range(rnd.choice([0, 1, 2, 8])):
                other[rnd.randrange(len(other))] = rnd.choice(vocab)
            texts.append(" ".join(other))
    texts += ["one two", "One, two!", "one two three", "", None, "!!", texts[0], texts[0].upper()]
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def brute_classes(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in range(len(texts))}


def test_chains_of_variants(spark):
    """Each text y is like one x only, and of nearly all buckets of both a third text is the centre."""
    rnd = random.Random(9)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(500)]
    texts = [rnd.choices(vocab, k=104)]
    for _ in range(40):
        x = texts[0][:-2] + rnd.choices(vocab, k=2)
        y = list(x)
        for at in rnd.sample(range(5, 95, 5), 2):
            y[at] = rnd.choice(vocab)
        texts += [x, y]
    texts = [" ".join(t) for t in texts]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_unlike_texts_of_a_family_are_not_compared(spark, monkeypatch):
    """Variants of one text with similarities of about 0.6: they meet in many fine buckets, but few pairs reach the exact check; links are found."""
    rnd = random.Random(12)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(4000)]
    hub, texts = rnd.choices(vocab, k=300), []
    for _ in range(60):
        x = list(hub)
        for at in rnd.sample(range(2, 298, 6), 8):
            x[at] = rnd.choice(vocab)
        texts.append(x)
        if rnd.random() < 0.3:
            texts.append([*x[:150], rnd.choice(vocab), *x[151:]])
    texts = [" ".join(t) for t in texts]
    tested, check = [], near_dedup._verified

    def verified(pairs, *rest):
        tested.append(pairs.count())
        return check(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_verified", verified)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute_classes(texts) and 1 < len(set(got.values())) < len(texts)
    assert len(tested) > 1 and sum(tested[1:]) < len(texts)


def test_two_bits_of_a_coordinate_tell_pairs_apart():
    """A pair of similarity 0.8 passes, one of 0.6 hardly ever; the bits of a band are equal where its keys are."""
    rng = np.random.default_rng(4)
    sig = rng.integers(1, 1 << 63, (2000, 640), dtype=np.uint64)
    for like, most, least in ((0.8, 0, 0), (0.6, 2000, 1980)):
        other = np.where(rng.random(sig.shape) < like, sig, rng.integers(1, 1 << 63, sig.shape, dtype=np.uint64))
        apart = 0
        for i in range(near_dedup.FINE_ROWS):
            planes = [near_dedup._planes(x[:, i :: near_dedup.FINE_ROWS] >> np.uint64(40), near_dedup.COORDINATE_BITS) for x in (sig, other)]
            seen = np.bitwise_or.reduce([a ^ b for a, b in zip(*planes)])
            apart = apart + np.bitwise_count(seen.view(np.uint64))[:, 0].astype(int)
        assert least <= (apart > near_dedup._most_differing(0.8)).sum() <= most
    keys = [near_dedup.band_keys(x, near_dedup.FINE_BANDS) for x in (sig, other)]
    bands = [near_dedup._planes(k.view(np.uint64), near_dedup.BAND_BITS) for k in keys]
    differ = np.bitwise_or.reduce([a ^ b for a, b in zip(*bands)]).view(np.uint64)
    bits = (differ >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    assert not bits[keys[0] == keys[1]].any() and (bits == 0).sum() <= (keys[0] == keys[1]).sum() + 3


def test_keep_one_of_repeated_rows(spark):
    """Repeated rows, like texts under one id, and null ids: one row of each class; rows without words stay."""
    like = [" ".join(f"{name}{k}" for k in range(60)) for name in "abcd"]
    rows = [(1, like[0], "x"), (1, like[0], "y"), (1, like[0], "x"), (2, like[0], "x"), (5, like[1], "p"), (5, like[1] + " more", "p"), (9, like[1], "p")]
    rows += [(None, like[2], "n"), (None, like[2], "n"), (None, like[2] + " more", "n"), (5, like[3], "q"), (None, None, "e"), (None, None, "e"), (3, "!!", "e"), (3, "!!", "e")]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)).collect()
    worded = sorted((str(r.doc_id), r.text.split()[0]) for r in kept if r.source != "e")
    assert worded == [("1", "a0"), ("5", "b0"), ("5", "d0"), ("None", "c0")] and len(kept) == 8


def test_exact_similarity():
    left, right = ["a b c d e f a b c d e f", "", "x y"], ["a b c d e f", "", "y x"]
    assert near_dedup.similarities([t.encode() for t in left], [t.encode() for t in right]).tolist() == [2 / 6, 0, 0]
    assert near_dedup.similarities([left[0].encode()], [right[0].encode()], True).tolist() == [2 / 8]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(100, 100 + k) for k in range(1, 40)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)]
    edges += [(5, 5), (None, 3)]
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    found = connected_components(table)
    got = {r.node: r.root for r in found.collect()}
    assert got == {r.node: r.root for r in connected_components(table, 0).collect()}
    assert found.rdd.getNumPartitions() == 1
    near = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got.get(start, start) == min(seen)


def brute_repeats(docs):
    seen, out = set(), {}
    for i, raw in docs:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            else:
                seen.add(raw[p : p + 100])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return out


def test_suffix_array():
    rnd = random.Random(4)
    for n in (0, 1, 40, 2000):
        raw = bytes(rnd.choice(b"ab\x01") for _ in range(n)) + b"\0"
        order, word = repeats.suffix_array(np.frombuffer(raw, np.uint8))
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        shared = repeats.common_prefixes(order, word)
        for a, b in zip(order[1:], order[:-1]):
            k = 0
            while k < 100 and max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
                k += 1
            assert min(shared[a], 100) == k


@pytest.mark.parametrize("seed", [5, 6])
def test_repeats(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choices("abcdefgh é漢", k=rnd.randint(50, 400))) for _ in range(25)]
    noise = lambda: "".join(rnd.choices("abcdefgh ", k=rnd.randint(0, 300)))
    texts = ["".join(rnd.choice(passages)[rnd.randint(0, 40) :] if rnd.random() < 0.6 else noise() for _ in range(rnd.randint(0, 5))) for _ in range(150)]
    texts += ["a" * 5000, "a" * 99, "ab" * 400, None, "", "xyz" * 300, texts[7], "q" * 100, "q" * 100]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in repeats.remove_repeats(frame(spark, texts)).collect()}
    assert got == brute_repeats([(i, (t or "").encode()) for i, t in enumerate(texts)])


def test_repeated_rows_in_different_slices(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choices("abcdefghij", k=n)) for n in (2_300_000, 2_100_000, 500)]
    rows = [(i, t) for i, t in enumerate(texts)] * 2 + [(7, texts[2] + texts[0][:300])]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0), (2, 0), (7, 800)]
    merge, row = repeats._Merge(), (1, 5, 0, 41, texts[0][:140].encode())
    assert merge.block([row, row]) == merge.block([row]) == []


def test_merge_over_blocks():
    """The windows of one anchor that come in several blocks, against one block."""
    rnd = random.Random(7)
    core = bytes(rnd.choices(b"abcdef", k=120))
    rows = [(1, d, 0, 41, bytes([65 + d % 3]) * 10 + core + bytes([65 + d % 5]) * 10) for d in range(20)]
    rows = [(g, d, low, n, raw[: n + 99]) for g, d, low, n, raw in rows]
    flat = lambda found: sorted((d, k) for d, low, n in found for k in range(low, low + n))
    whole = flat(repeats._Merge().block(rows))
    merge, split = repeats._Merge(), []
    for k in range(0, 20, 3):
        split += merge.block(rows[k : k + 3])
    assert flat(split) == whole
    seen, want = set(), []
    for _, d, low, n, raw in rows:
        for k in range(n):
            if raw[k : k + 100] in seen:
                want.append((d, k))
            seen.add(raw[k : k + 100])
    assert whole == sorted(want)


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:400] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 3), (5004, [None] + [1.0] * 15), (5050, [float("inf")] * 16)]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").repartition(4)
    got = neighbours.nearest(table, "vec_id % 50 = 0").collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    found = total = 0
    for q in range(0, 3000, 50):
        score = unit @ unit[q]
        score[q] = -9
        want = sorted(range(3000), key=lambda i: (-round(score[i], 12), i))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in mine)
        found += len(set(want) & {r.vec_id for r in mine})
        total += 5
    assert found / total >= 0.9
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 100), key=lambda r: r["rank"])] == [50, 101, 102, 103, 104]
    few = spark.createDataFrame(rows[:3] + odd, "vec_id bigint, embedding array<float>")
    assert neighbours.nearest(few, "vec_id = 0").count() == 2
    assert neighbours.nearest(few.where("false"), "true").count() == 0


def test_neighbours_of_small_clusters(spark, monkeypatch):
    """Three near vectors far from all others have a list of their own and still get five rows."""
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(size=(1500, 8)) * 0.01 + np.eye(8)[k % 4] for k in range(2)] + [rng.normal(size=(3, 8)) * 0.001 - np.eye(8)[5]])
    lonely = neighbours._unit(np.vstack([x[:1], x[1500:1501], x[-1:]]))
    index = neighbours.Index(lonely, np.argsort(neighbours._distances(lonely, lonely), axis=1)[:, 1:], np.arange(3))
    monkeypatch.setattr(neighbours, "build_index", lambda sample, lists: index)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(table, "vec_id >= 2999", ratio=1.0).collect()
    assert collections.Counter(r.query_id for r in got) == {i: 5 for i in range(2999, 3003)}
    unit = neighbours._unit(x)
    score = unit @ unit[3002]
    score[3002] = -9
    assert [r.vec_id for r in sorted(got, key=lambda r: (r.query_id, r["rank"])) if r.query_id == 3002][:2] == np.argsort(-score)[:2].tolist()
    index = neighbours.Index(lonely, index.graph, index.entries)
    rows, lists = neighbours.probed_lists(index, lonely[2:], 1.0, np.array([2, 1, 3]), 6)
    assert (rows == 0).all() and 2 in lists and len(lists) == 3


def test_neighbours_of_repeated_ids(spark):
    """Query and candidate rows given several times, and ids with several vectors."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(200, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += rows[:5] * 4 + rows[100:140] * 2 + [(150 + i % 3, v.tolist()) for i, v in enumerate(x[:20] + 0.01)] + [(0, x[77].tolist())]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = neighbours.nearest(table, "vec_id < 20").collect()
    ids, unit = np.array([r[0] for r in rows]), neighbours._unit(np.array([r[1] for r in rows]))
    score = unit @ unit.T
    for q in range(20):
        best = {v: score[np.ix_(ids == q, ids == v)].max() for v in set(ids.tolist()) - {q}}
        want = sorted(best, key=lambda v: (-round(best[v], 12), v))[:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


SCHEMAS = {"f": {"x": ("integer", True), "y": ("number", False), "z": ("string", False)}, "g": {"a": ("array", False), "b": ("boolean", False), "o": ("object", False)}}
MESSAGES = f"conv_id bigint, turn bigint, role string, content string, tool_calls array<{tool_calls.CALL}>, tool_call_id string, json string, errors int"


def call(i, name, arguments, *needs):
    return (i, name, arguments, list(needs))


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", 'say "hi"', None, None, None, 0),
        (1, 1, "assistant", None, [call("c", "f", '{"y": 1.50, "x": 3}', "b"), call("b", "g", '{"o":{"k":1,"a":[2, 1]},"b":true}'), call("l", "f", '{"x":1}', "m"), call("m", "f", "[1]", "l")], None, None, 0),
        (1, 2, "tool", "late", None, "c", None, 0),
        (1, 3, "tool", "early", None, "b", None, 0),
        (1, 4, "tool", "whose?", None, "zz", None, 0),
        (2, 0, "assistant", "", [call("c", "f", '{"x":"3","q":null,"z":1}'), call("d", "h", "{}"), call("e", "f", "{"), call("k", "f", None)], None, None, 0),
        (2, 1, None, None, [], None, None, 0),
        (None, 1, "user", "lost", None, None, None, 0),
        (3, 0, "assistant", "", [call("r", "g", "{}")], None, None, 0),
        (3, 1, "tool", "one", None, "r", None, 0),
        (3, 2, "assistant", "", [call("r", "g", '{"a":[]}')], None, None, 0),
        (3, 3, "tool", "two", None, "r", None, 0),
    ]
    got = tool_calls.link_calls(spark.createDataFrame(rows, MESSAGES), SCHEMAS).orderBy("conv_id", "turn", "call", "step", "result_turn").collect()
    one = [(r.kind, r.call_id, r.linked, r.cyclic) for r in got if r.conv_id == 1]
    assert one == [
        ("message", None, None, False), ("message", None, None, False), ("call", "b", True, False), ("result", "b", True, False),
        ("call", "c", True, False), ("result", "c", True, False), ("call", "l", False, True), ("call", "m", False, True), ("orphan", "zz", False, False),
    ]
    json = {(r.conv_id, r.turn, r.kind, r.call_id): r.json for r in got}
    assert json[1, 1, "call", "c"] == '{"arguments":{"x":3,"y":1.5},"id":"c","name":"f"}'
    assert json[1, 1, "call", "b"] == '{"arguments":{"b":true,"o":{"a":[2,1],"k":1}},"id":"b","name":"g"}'
    assert json[1, 0, "message", None] == '{"content":"say \\"hi\\"","role":"user"}'
    errors = {(r.conv_id, r.call_id): r.errors for r in got if r.kind == "call"}
    assert errors[2, "c"] == ["type:x", "type:z", "unknown:q"] and errors[2, "d"] == ["unknown_tool"]
    assert errors[2, "e"] == errors[2, "k"] == errors[1, "m"] == ["malformed"] and errors[1, "c"] == []
    assert [(r.turn, r.call_id, r.result_turn) for r in got if r.conv_id == 3 and r.kind == "result"] == [(0, "r", 1), (2, "r", 3)]
    assert tool_calls.link_calls(spark.createDataFrame([], MESSAGES), SCHEMAS).count() == 0


def test_transcripts(spark, tmp_path):
    rows = [(c, t, "user", f"{c}-{t}", None, None, None, 0) for c in range(3) for t in range(40)]
    linked = tool_calls.link_calls(spark.createDataFrame(rows, MESSAGES).repartition(5), SCHEMAS)
    tool_calls.write_transcripts(linked, str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert [re.search(r"\d+-\d+", x)[0] for x in lines] == [f"{c}-{t}" for c in range(3) for t in range(40)]


def test_odd_rows(spark, odd):
    n = len(ODD_TEXTS)
    assert sharding.assign_shards(odd).count() == n
    classes = near_dedup.near_duplicates(odd).collect()
    assert len(classes) == n
    assert {(r.doc_id, r.class_id) for r in classes if r.doc_id in (1, 2, 3, 6)} == {(1, 1), (2, 2), (3, 3), (6, 1)}
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == n - 2
    removed = repeats.remove_repeats(odd)
    assert removed.count() == n
    # A repeats its window from the second byte on, so its first byte alone is not covered; copies under one id keep theirs.
    assert {r.doc_id: r.n_removed for r in removed.collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 199_995, 6: 0, None: 0, 7: 0, 8: 49_999}
    for empty in (sharding.assign_shards, near_dedup.near_duplicates, near_dedup.keep_one, repeats.remove_repeats):
        assert empty(odd.where("false")).count() == 0


def test_keep_one_with_names_of_its_own(spark):
    """Columns that are called as the operator's own, or hold a dot, come back as they are."""
    rows = [(i, "w1 w2 w3 w4 w5 w6 w7 w8 w9", f"mark{i}", "x", "dot") for i in (3, 1, 2, 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, _text_node string, _id string, `a.b` string")
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [rows[1]]


def test_pipeline(spark, tmp_path, odd):
    """Every stage on odd rows; what it keeps is what the operators alone say."""
    passage = " ".join(f"w{k}" for k in range(40))
    toxic = [(100 + i, ("grumbold snarkwort " if i % 4 == 0 else "") + " ".join(random.Random(i).choices("abcdefgh", k=30)), int(i % 4 == 0)) for i in range(400)]
    more = spark.createDataFrame([(r[0], r[1]) for r in toxic] + [(900, "clean start " + passage), (901, "q" * 120), (902, "x " * 400 + "q" * 120)], "doc_id bigint, text string")
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        more.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], r[2]) for r in toxic], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "pieces":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in now.collect()}
    gone = {r[0] for r in toxic if r[2]}
    assert not kept["toxicity"] & gone and kept["toxicity"] >= {1, 2, 3, 900, 901, 902, None}
    assert 6 not in kept["near_duplicates"] and {1, 900, 901, 902, None} <= kept["near_duplicates"]
    cut = spark.read.parquet(str(tmp_path / "repeats")).where("doc_id = 902").first()
    assert "q" not in cut.text and cut.n_chars == len(cut.text)
    assert 900 not in kept["decontamination"] and 901 in kept["decontamination"]
    assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(whole.collect(), key=str) == sorted(now.collect(), key=str)


def test_words_of_no_text():
    assert len(split_words([b"", b""]).starts) == 0
