"""Suffix-array dedup: remove every byte that a 100-byte string covers which also starts earlier.

1. *Candidates.* Of the 24-byte grams of a 100-byte window the one with the least hash is its anchor. Equal windows have equal anchors, so
   only windows whose anchor occurs twice in the corpus can repeat. An anchor row is a hash, a document key and a run of windows.
   A document whose whole text is that of an earlier one repeats in all its windows; it needs no suffix array and sends no bytes.
2. *Shards.* The other documents come together with their candidate windows. Each task cuts them into shards of some megabytes and builds the suffix
   array of a shard's candidate regions by Larsson-Sadakane refinement: ranks of 8-byte prefixes first, then ranks of prefixes twice as long
   for the suffixes that are still tied. Kasai's common prefixes group equal windows; all but the earliest of a group are repeats.
3. *Merging.* What is left of each anchor's windows goes, with its bytes, to the anchor's task. A passage that a shard holds many
   times arrives once. There the windows of all shards are merged in document order: those of each block are looked up by binary search in the sorted windows before.
4. *Removal.* The runs of repeats come back to their documents, and the bytes they cover go.

Earlier means smaller ``doc_id`` (null last), ties by a hash of id and text, or the same row and an earlier start.

Defined cases: null is empty; texts under 100 bytes keep all; rows that repeat an id and a text are one document, and each of them gets its
result; copies of a text under another id go whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .text import as_bytes, mix, powers, prefix_hash, slices

LENGTH = 100
GRAM = 24
SHARD_BYTES = 4 << 20
MERGE_BYTES = 2 << 20
_SPREAD = LENGTH - GRAM + 1
_PLACE_BITS = 28
_LANE = 128


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from the running minima of blocks in both directions."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, gram hash, first window and number of windows of each anchor, and whether it has several places.

    Neighbouring anchors of one gram are one row, so a text of one letter has one row.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if len(buf) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    c = prefix_hash(buf)
    gram = mix((c[GRAM:] - c[:-GRAM]) * powers(len(buf), inverse=True)[: len(buf) - GRAM + 1])
    place_mask = np.uint64((1 << _PLACE_BITS) - 1)
    least = _window_min((gram & ~place_mask) | np.arange(len(gram), dtype=np.uint64), _SPREAD)
    begins = np.cumsum(sizes) - sizes
    n = np.maximum(0, sizes - LENGTH + 1)
    text = np.repeat(np.arange(len(texts)), n)
    window = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    at = (least[begins[text] + window] & place_mask).astype(np.int64)
    code = gram[at].view(np.int64)
    starts = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (code[1:] != code[:-1]))) if len(text) else np.zeros(0, np.int64)
    n = np.diff(np.append(starts, len(text)))
    return text[starts], code[starts], window[starts], n, at[starts] != at[starts + n - 1]


def suffix_array(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the 8 bytes at each place as a number."""
    n = len(buf)
    padded = np.append(buf, np.zeros(8, np.uint8)).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : n + k]
    order = np.argsort(word, kind="stable")
    first = np.append(True, word[order[1:]] != word[order[:-1]])
    slot_of_group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = slot_of_group
    tied = ~(first & np.append(first[1:], True))
    slots = np.flatnonzero(tied)
    width = 8
    while len(slots):
        suffix = order[slots]
        group = rank[suffix]
        ahead = suffix + width
        nextrank = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        # Groups occupy neighbouring slots, so sorting by group and then by the next rank permutes slots inside groups.
        by = np.lexsort((nextrank, group))
        suffix, group, nextrank = suffix[by], group[by], nextrank[by]
        order[slots] = suffix
        first = np.append(True, (group[1:] != group[:-1]) | (nextrank[1:] != nextrank[:-1]))
        rank[suffix] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        slots = slots[~(first & np.append(first[1:], True))]
        width *= 2
    return order, word


def common_prefixes(order: np.ndarray, word: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For each place, the bytes (at most about ``most``) its suffix shares with the one before it in order.

    Kasai's rule: the prefix of the next place is at most one byte shorter. Lanes of 128 neighbouring places move in step, and bytes
    are compared eight at a time.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    lanes = np.arange(0, n, _LANE)
    length = np.zeros(len(lanes), np.int64)
    for step in range(min(_LANE, n)):
        at = lanes + step
        if at[-1] >= n:
            lanes, at, length = lanes[:-1], at[:-1], length[:-1]
        length = np.maximum(length - 1, 0)
        pred = before[at]
        length[pred < 0] = 0
        go = np.flatnonzero(pred >= 0)
        while len(go):
            a, b = at[go] + length[go], pred[go] + length[go]
            inside = (a < n) & (b < n)
            go, a, b = go[inside], a[inside], b[inside]
            differ = word[a] ^ word[b]
            equal = np.where(differ == 0, 8, 0)
            some = np.flatnonzero(differ)
            # Leading zero bytes of the difference.
            for k in range(1, 8):
                equal[some] += (differ[some] >> np.uint64(64 - 8 * k)) == 0
            length[go] += equal
            go = go[(equal == 8) & (length[go] < most)]
        shared[at] = length
    return shared


def shard_repeats(texts: list[bytes], runs: list[list[tuple[int, int]]]) -> list[np.ndarray]:
    """Per text (in document order) the candidate windows that also start earlier in the shard; ``runs`` are disjoint window runs."""
    pieces, text_of, at_of, size_of = [], [], [], []
    for d, own in enumerate(runs):
        for low, high in own:
            pieces.append(texts[d][low : high + LENGTH - 1])
            text_of.append(d)
            at_of.append(low)
            size_of.append(high - low)
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    if not pieces:
        return found
    # UTF-8 has no byte above 0xF4, so bytes move up by one and 0 separates the regions.
    glued = b"\x00".join(p.translate(_UP) for p in pieces) + b"\x00"
    buf = np.frombuffer(glued, np.uint8)
    order, word = suffix_array(buf)
    shared = common_prefixes(order, word)
    size = np.array(size_of)
    begin = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
    region = np.repeat(np.arange(len(pieces)), size)
    offset = np.arange(len(region)) - np.repeat(np.cumsum(size) - size, size)
    windows = begin[region] + offset
    is_window = np.zeros(len(buf), bool)
    is_window[windows] = True
    # A window is at least LENGTH bytes long, so everything in a group of equal starts is a window or reaches over its region's end.
    group = np.cumsum(shared[order] < LENGTH)
    chosen = is_window[order]
    place, group = order[chosen], group[chosen]
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    earliest = np.minimum.reduceat(place, heads)
    repeated = np.zeros(len(buf), bool)
    repeated[place] = place != np.repeat(earliest, np.diff(np.append(heads, len(place))))
    hit = repeated[windows]
    text = np.array(text_of)[region[hit]]
    start = np.array(at_of)[region[hit]] + offset[hit]
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    return [start[bounds[d] : bounds[d + 1]] for d in range(len(texts))]


_UP = bytes((i + 1) % 256 for i in range(256))


def to_runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Runs (first, end) of neighbouring numbers."""
    if not len(sorted_values):
        return []
    cut = np.flatnonzero(np.diff(sorted_values) != 1)
    return list(zip(sorted_values[np.append(0, cut + 1)].tolist(), (sorted_values[np.append(cut, len(sorted_values) - 1)] + 1).tolist()))


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        text, code, low, n, several = anchors(as_bytes(part.column("text")))
        place = (low << 32) | (several.astype(np.int64) << 31) | n
        doc = part.column("doc").to_numpy()[text]
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(doc), pa.array(place)], ["gram", "doc", "place"])


_SNIPPET = ["gram", "last", "doc_id", "doc", "low", "n", "bytes"]


def _first_level(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SHARD_BYTES):
            ids, docs, copies = (part.column(c).to_pylist() for c in ("doc_id", "doc", "copy"))
            whole = as_bytes(part.column("text"))
            order = sorted((i for i in range(len(docs)) if not copies[i]), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i], docs[i]))
            order = [i for k, i in enumerate(order) if not k or docs[i] != docs[order[k - 1]]]
            held = part.column("held").to_pylist()
            places = [sorted({(h["place"] >> 32, h["place"] & 0x7FFFFFFF, h["gram"]) for h in held[i]}) for i in order]
            runs = [_union([(low, low + n) for low, n, _ in own]) for own in places]
            repeats = shard_repeats([whole[i] for i in order], runs)
            rows: list[tuple] = []
            for i in range(part.num_rows):
                if copies[i] and len(whole[i]) >= LENGTH:
                    rows.append((docs[i], ids[i] is None, ids[i], docs[i], 0, len(whole[i]) - LENGTH + 1, None))
            for i, own, gone in zip(order, places, repeats):
                head = (ids[i] is None, ids[i], docs[i])
                rows += [(docs[i], *head, low, high - low, None) for low, high in to_runs(gone)]
                gone_set = np.zeros(0, np.int64) if not len(gone) else gone
                for low, n, gram in own:
                    a, b = np.searchsorted(gone_set, (low, low + n))
                    if a == b:
                        left = [(low, low + n)]
                    else:
                        left = to_runs(np.setdiff1d(np.arange(low, low + n), gone_set[a:b], assume_unique=True))
                    rows += [(gram, *head, s, e - s, whole[i][s : e + LENGTH - 1]) for s, e in left]
            columns = list(zip(*rows)) or [()] * len(_SNIPPET)
            types = [pa.int64(), pa.bool_(), kind, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _SNIPPET)

    return run


class _Merge:
    """Windows of the anchors of one task, in document order; ``known`` are the sorted windows of the anchor that is still open."""

    def __init__(self):
        self.gram = None
        self.known = np.zeros(0, np.uint64)
        self.first: dict[bytes, tuple] = {}

    def block(self, rows: list[tuple]) -> list[tuple]:
        """Runs of repeated windows (doc, low, n). Rows are (gram, identity, doc, low, n, bytes)."""
        out, fresh = [], []
        for gram, doc, low, n, raw in rows:
            if gram != self.gram:
                self.gram, self.first = gram, {}
                fresh.append([])
            elif not fresh:
                fresh.append([])
            owner = self.first.get(raw)
            if owner is None:
                self.first[raw] = (doc, low)
                fresh[-1].append((gram, doc, low, n, raw))
            elif owner != (doc, low):
                # The owner's own snippet that comes again is no repeat of itself.
                out.append((doc, low, n))
        open_gram = self.gram
        # An anchor with one spelling and no earlier block holds no further repeats, unless its spelling repeats itself.
        pending = [row for own in fresh for row in own]
        if pending:
            out += self._windows(pending, open_gram)
        return out

    def _windows(self, rows: list[tuple], open_gram: int) -> list[tuple]:
        size = np.array([r[3] for r in rows])
        raw = b"".join(r[4] for r in rows)
        buf = np.frombuffer(raw, np.uint8)
        begin = np.cumsum([0] + [len(r[4]) for r in rows[:-1]])
        row = np.repeat(np.arange(len(rows)), size)
        at = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        c = prefix_hash(buf)
        code = mix((c[at + LENGTH] - c[at]) * powers(len(buf), inverse=True)[at])
        order = np.argsort(code, kind="stable")
        head = np.append(True, code[order[1:]] != code[order[:-1]])
        repeated = np.ones(len(code), bool)
        repeated[order[head]] = False
        grams = np.array([r[0] for r in rows])[row]
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
            repeated |= self.known[place] == code
        mine = np.unique(code[grams == open_gram])
        same = self.open_gram == open_gram if hasattr(self, "open_gram") else False
        self.known = np.union1d(self.known, mine) if same else mine
        self.open_gram = open_gram
        out = []
        hit = np.flatnonzero(repeated)
        if len(hit):
            window = hit - (np.cumsum(size) - size)[row[hit]]
            cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(row[hit]) != 0))
            for a, b in zip(np.append(0, cut + 1), np.append(cut, len(hit) - 1)):
                _, doc, low, _, _ = rows[row[hit[a]]]
                out.append((doc, low + int(window[a]), int(b - a + 1)))
        return out


def _second_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merge = _Merge()
    for batch in batches:
        for part in slices(iter([batch]), "bytes", MERGE_BYTES):
            columns = [part.column(c).to_pylist() for c in ("gram", "doc", "low", "n", "bytes")]
            done = [(doc, low, n) for _, doc, low, n, raw in zip(*columns) if raw is None]
            done += merge.block([row for row in zip(*columns) if row[-1] is not None])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], ["doc", "low", "n"])


def _remove(names: list[str], text_col: str, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            kept, removed, spans = [], [], []
            for text, runs in zip(as_bytes(part.column(text_col)), part.column("runs").to_pylist()):
                gone = _union([(r["low"], r["low"] + r["n"] + LENGTH - 1) for r in runs or ()])
                at, left = 0, []
                for low, high in gone:
                    left.append(text[at:low])
                    at = high
                kept.append(b"".join(left) + text[at:])
                removed.append(len(text) - len(kept[-1]))
                spans.append([{"first_byte": a, "end_byte": b} for a, b in gone])
            sizes = pa.array([len(k) + r for k, r in zip(kept, removed)], pa.int64())
            left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            made = [left, sizes, pa.array(removed, pa.int64()), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], [*names, *_MADE])

    return run


_MADE = {"kept": "binary", "n_bytes": "bigint", "n_removed": "bigint", "spans": "array<struct<first_byte: bigint, end_byte: bigint>>"}
_SPANS = pa.list_(pa.struct([("first_byte", pa.int64()), ("end_byte", pa.int64())]))


def _copies(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Keys of the documents whose whole text an earlier document has; of a text, only narrow rows meet."""
    keyed = rows.select(F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("digest"), F.struct(F.col(doc_id).isNull(), F.col(doc_id), "doc").alias("at"))
    first = keyed.groupBy("digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.doc").alias("first"))
    later = keyed.join(first, "digest").where("at.doc <> first")
    return later.select(F.col("at.doc").alias("doc"), F.lit(True).alias("copy")).distinct()


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, as_text: bool = False
) -> DataFrame:
    """Columns ``keep`` (the id, unless given) of each row with ``kept`` bytes, ``n_bytes``, ``n_removed`` and removed ``spans``.

    ``as_text``: ``kept`` is text, without the bytes of characters that a removed run has cut.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [id_col] if keep is None else list(keep)
    types = dict(docs.dtypes)
    carried = list(dict.fromkeys([*names, id_col, text_col]))
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(carried)])
    own = {c: f"_{i}" for i, c in enumerate(carried)}
    doc_id, text = own[id_col], own[text_col]
    rows = rows.withColumn("doc", F.xxhash64(doc_id, text))
    found = rows.select("doc", F.col(text).alias("text")).mapInArrow(_anchor_rows, "gram bigint, doc bigint, place bigint")
    near = Window.partitionBy("gram").orderBy("place")
    # An anchor that has a neighbour of its gram is shared; looking at the neighbours holds no group in memory.
    found = found.repartition(parts, "gram").withColumn("before", F.lag("place").over(near)).withColumn("after", F.lead("place").over(near))
    shared = found.where(f"before IS NOT NULL OR after IS NOT NULL OR (place & {1 << 31}L) <> 0")
    held = shared.groupBy("doc").agg(F.collect_list(F.struct("gram", "place")).alias("held"))
    # Both joins use this exchange of the documents.
    placed = rows.repartition(parts, "doc")
    kind = pa.string() if types[id_col] == "string" else pa.int64()
    level = placed.join(held, "doc").join(_copies(rows, doc_id, text), "doc", "left")
    level = level.withColumns({"doc_id": F.col(doc_id), "text": F.col(text), "copy": F.coalesce("copy", F.lit(False))})
    # Repeated rows are one document: of those with one key, which may come in different slices and tasks, one goes on.
    level = level.select("doc_id", "doc", "text", "copy", "held").dropDuplicates(["doc"])
    schema = f"gram bigint, last boolean, doc_id {'string' if types[id_col] == 'string' else 'bigint'}, doc bigint, low bigint, n bigint, bytes binary"
    level = level.mapInArrow(_first_level(kind), schema).repartition(parts, "gram").sortWithinPartitions("gram", "last", "doc_id", "doc", "low")
    runs = level.mapInArrow(_second_level, "doc bigint, low bigint, n bigint")
    runs = runs.groupBy("doc").agg(F.collect_list(F.struct("low", "n")).alias("runs"))
    out = placed.join(runs, "doc", "left").select(*own.values(), "runs")
    kinds = _MADE | ({"kept": "string"} if as_text else {})
    schema = ", ".join([*(f"{own[c]} {types[c]}" for c in names), *(f"{c} {t}" for c, t in kinds.items())])
    made = out.mapInArrow(_remove([own[c] for c in names], text, as_text), schema)
    return made.select(*[F.col(own[c]).alias(c) for c in names], *_MADE)


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
