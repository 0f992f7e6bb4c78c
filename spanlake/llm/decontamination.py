"""Benchmark decontamination by Wu-Manber search on words.

A pattern is a window of 13 consecutive words of an item (an item of fewer words is one window). Blocks are two
words. ``shift`` says, for the hashed block that ends a text window, how many words on the next occurrence may start
at the earliest; where it is 0, the suffix block selects a bucket of patterns, the prefix block thins it out, word codes
are compared, and the bytes decide. All lanes of a batch (64 window starts of one text each) move in step.

The items are a query set: they are broadcast in blocks of about ``block_bytes`` and ``block_items``, and the table passes
through one narrow step per block, without a shuffle. The blocks come one after the other: what a block has found is checkpointed
before the next one is read, so the driver and the executors hold one block, however many there are.

Defined cases: null texts and texts without words have no hit; items that are null in id or text, or have no words, take
no part; an item id that is given several times counts once; an empty item table gives no hits; rows are independent;
other columns of the input are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir
from .text import FOLD, Words, as_bytes, slices, split_words, word_codes

WINDOW = 13
BLOCK_BYTES = 16 << 20
BLOCK_ITEMS = 100_000
LANE = 64
_SPAN = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))


def _blocks(codes: np.ndarray, width: int) -> np.ndarray:
    """A code of the block of ``width`` words that starts at each word."""
    if width == 1:
        return codes
    out = codes * np.uint64(0x9FB21C651E98DF25)
    out[:-1] += codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(31))


class Patterns:
    """Wu-Manber tables of the windows of one length."""

    def __init__(self, windows: dict[bytes, list[str]], length: int):
        self.length, self.width = length, min(2, length)
        self.windows = sorted(windows)
        self.items = [windows[w] for w in self.windows]
        self.codes = word_codes(split_words(self.windows)).reshape(len(self.windows), length)
        blocks = np.stack([_blocks(row, self.width) for row in self.codes])
        last = length - self.width
        self.mask = np.uint64((1 << max(16, (4 * blocks.size).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, last + 1, np.int64)
        for at in range(last + 1):
            np.minimum.at(self.shift, (blocks[:, at] & self.mask).astype(np.int64), last - at)
        self.order = np.argsort(blocks[:, last], kind="stable")
        self.suffix = blocks[self.order, last]
        self.prefix = blocks[self.order, 0]

    def search(self, words: Words, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (first word) and window numbers of all occurrences."""
        n = self.length
        low, high = words.first[:-1], words.first[1:] - n + 1
        lanes = np.maximum(0, -(-(high - low) // LANE))
        of = np.repeat(np.arange(len(low)), lanes)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = low[of] + nth * LANE
        stop = np.minimum(at + LANE, high[of])
        blocks = _blocks(codes, self.width)
        found = []
        while len(at):
            step = self.shift[(blocks[at + n - self.width] & self.mask).astype(np.int64)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        if not len(at):
            return at, at
        suffix = blocks[at + n - self.width]
        begin, end = np.searchsorted(self.suffix, suffix, "left"), np.searchsorted(self.suffix, suffix, "right")
        size = end - begin
        entry = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        at = np.repeat(at, size)
        near = self.prefix[entry] == blocks[at]
        at, entry = at[near], entry[near]
        for k in range(n):
            same = codes[at + k] == self.codes[self.order[entry], k]
            at, entry = at[same], entry[same]
        window = self.order[entry]
        exact = np.fromiter((words.bytes_of(a, a + n) == self.windows[w] for a, w in zip(at, window)), bool, len(at))
        return at[exact], window[exact]


def build_patterns(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[Patterns]:
    by_length: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
    for item, text in sorted(set(items)):
        words = text.translate(FOLD).split()
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            owners = by_length[n][b" ".join(words[i : i + n])]
            if not owners or owners[-1] != item:
                owners.append(item)
    return [Patterns(dict(windows), n) for n, windows in sorted(by_length.items())]


def _occurrences(texts: list[bytes], patterns: list[Patterns]) -> tuple[np.ndarray, list[list], list[set[str]]]:
    """Per text: number of words, runs of hit words, items."""
    words = split_words(texts)
    n_docs, n_words = len(texts), len(words.starts)
    items: list[set[str]] = [set() for _ in range(n_docs)]
    cover = np.zeros(n_words + 1, np.int64)
    codes = word_codes(words) if n_words else np.zeros(0, np.uint64)
    for p in patterns:
        at, window = p.search(words, codes)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + p.length, -1)
        doc = np.searchsorted(words.first, at, side="right") - 1
        for pair in np.unique(doc * len(p.windows) + window):
            d, w = divmod(int(pair), len(p.windows))
            items[d].update(p.items[w])
    hit = np.cumsum(cover)[:n_words] > 0
    runs: list[list] = [[] for _ in range(n_docs)]
    for d in [d for d in range(n_docs) if items[d]]:
        low, high = words.first[d], words.first[d + 1]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit[low:high].view(np.int8), [0]))))
        runs[d] = edges.reshape(-1, 2).tolist()
    return np.diff(words.first), runs, items


def _merge(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


@lru_cache(maxsize=2)
def _tables(items: tuple[tuple[str, bytes], ...], window: int) -> list[Patterns]:
    return build_patterns(list(items), window)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int, block_items: int) -> list[DataFrame]:
    """The items in blocks of about this size (at least one block), as columns ``item`` and ``text``."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // block_items), -(-size // block_bytes), 1)
    if parts == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part) for part in range(parts)]


def find_items(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    block_items: int = BLOCK_ITEMS,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``) with ``n_words``, ``hits`` (runs of hit words) and ``items``."""
    names = list(keep)
    own = {"n_words": "bigint", "hits": "array<struct<first_word: bigint, end_word: bigint>>", "items": "array<string>"}
    clash = sorted(set(names) & set(own))
    if clash:
        raise ValueError(f"columns {clash} are results of this operator")
    carried = names if text_col in names else [*names, text_col]
    types = dict(docs.dtypes)
    shared_dir(docs.sparkSession)
    blocks = item_blocks(items, "item_id", "text", block_bytes, block_items)
    df = docs.select(*carried)
    for k, block in enumerate(blocks):
        last = k + 1 == len(blocks)
        out = [*(names if last else carried), *own]
        # Repeated rows of an item are one; the block is bounded.
        known = tuple(sorted((r.item, r.text.encode()) for r in block.distinct().collect()))
        shared = df.sparkSession.sparkContext.broadcast((known, window))
        schema = ", ".join(f"`{c}` {own.get(c) or types[c]}" for c in out)
        df = df.mapInArrow(_step(shared, names if last else carried, text_col, k > 0), schema)
        if not last:
            df = df.checkpoint()
            shared.unpersist()
    return df


def _step(shared, names: list[str], text_col: str, again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _tables(*shared.value)
        for part in slices(batches, text_col):
            n, runs, items = _occurrences(as_bytes(part.column(text_col)), patterns)
            if again:
                for d, (old, known) in enumerate(zip(part.column("hits").to_pylist(), part.column("items").to_pylist())):
                    items[d].update(known)
                    runs[d] = _merge(runs[d] + [[r["first_word"], r["end_word"]] for r in old])
            hits = [[{"first_word": a, "end_word": b} for a, b in r] for r in runs]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in names]
                + [pa.array(n, pa.int64()), pa.array(hits, _SPAN), pa.array([sorted(s) for s in items], pa.list_(pa.string()))],
                [*names, "n_words", "hits", "items"],
            )

    return run


N_HIT = "aggregate(hits, 0L, (n, r) -> n + r.end_word - r.first_word)"
CONTAMINATED = f"{N_HIT} > 0 AND 20 * {N_HIT} >= n_words"


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        F.expr(N_HIT).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    A word hit covers at least a twentieth of the text's words in a contaminated row.
    """
    names = docs.columns
    own = [f"_c{i}" for i in range(len(names))]
    found = find_items(docs.toDF(*own), items, keep=tuple(own), text_col=own[names.index("text")], **options)
    return found.where(f"NOT ({CONTAMINATED})").select(*[F.col(o).alias(n) for o, n in zip(own, names)])
