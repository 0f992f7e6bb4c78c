"""Ranked lexical search with posting lists in geometric blocks, and bounds that keep the result exact.

A first pass turns each document into the terms of the items that it holds (with counts) and its length: a narrow table, from which Spark counts documents,
lengths and document frequencies. A second pass reads that table in chunks of ``CHUNK_DOCS`` documents. In a chunk every term has a posting list,
whose documents are clustered by similarity (inner products of random projections of their weighted terms, with about the square root of the list's length as
centres). Each cluster is a block; its summary is the largest value of each term over its documents (of the terms that share an item with the list's term).

An item visits its lists by falling bound. A block's bound is the item's weights times the summary, over the terms whose lists were not visited yet: a
document with an earlier term was met there, or was left out there by a bound of its own. A block is skipped only if its bound is below the
item's k-th best score so far, a list and all after it only if the sum of their largest values is. The k-th best scores begin with those over a sample of
about ``SEED_DOCS`` documents, which only save work. Every task keeps k documents per item; they are merged in two steps.

Items are taken in blocks of ``ITEM_BYTES`` of text, each searched against all documents.

Defined cases: a null text has no terms; documents and items without terms are in no result; a row is a document, so repeated
rows are ranked one after another; items are the distinct rows of (id, text); equal scores go by id, null last; empty tables
give an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import scratch_path
from .text import as_bytes, slices, split_words, word_codes

TOP = 50
ITEM_BYTES = 1 << 20
CHUNK_DOCS = 4096
SEED_DOCS = 4096
#: Numbers of a document's projection.
PROJECTION = 16
#: Bytes of block summaries that a task keeps at a time.
SUMMARY_BYTES = 128 << 20


@dataclass
class Terms:
    """Distinct terms of a block of items in the order of their codes, and the terms of each item."""

    codes: np.ndarray
    buf: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    items: list[np.ndarray]


def terms_of(texts: list[bytes]) -> Terms:
    words = split_words(texts)
    codes = word_codes(words) if len(words.starts) else np.zeros(0, np.uint64)
    known, first, at = np.unique(codes, return_index=True, return_inverse=True)
    starts, sizes = words.starts[first], (words.ends - words.starts)[first]
    items = [np.unique(at[words.first[i] : words.first[i + 1]]) for i in range(len(texts))]
    return Terms(known, words.buf, starts, sizes, items)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges that begin at ``starts``, one range after another."""
    return np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)


def _term_counts(texts: list[bytes], terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and text, term and count of every term of ``terms`` in it."""
    words = split_words(texts)
    n = np.diff(words.first)
    if not len(words.starts) or not len(terms.codes):
        return n, *(np.zeros(0, np.int64) for _ in range(3))
    codes = word_codes(words)
    at = np.minimum(np.searchsorted(terms.codes, codes), len(terms.codes) - 1)
    hit = np.flatnonzero(terms.codes[at] == codes)
    size = words.ends[hit] - words.starts[hit]
    hit, size = hit[size == terms.sizes[at[hit]]], size[size == terms.sizes[at[hit]]]
    # Equal codes and sizes; the bytes decide.
    same = words.buf[_spread(words.starts[hit], size)] == (terms.buf[_spread(terms.starts[at[hit]], size)])
    hit = hit[np.logical_and.reduceat(same, np.append(0, np.cumsum(size)[:-1]))] if len(hit) else hit
    text = np.searchsorted(words.first, hit, side="right") - 1
    key, count = np.unique(text * len(terms.codes) + at[hit], return_counts=True)
    return n, key // len(terms.codes), key % len(terms.codes), count


def _index(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, text, term, count = _term_counts(as_bytes(part.column("text")), terms.value)
            bounds = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"]).filter(pa.array(n > 0))

    return run


class Chunk:
    """Posting lists of some documents: values of their terms, sorted by document and by term."""

    def __init__(self, first: np.ndarray, term: np.ndarray, value: np.ndarray, weights: np.ndarray, partners: list[np.ndarray]) -> None:
        self.first, self.term, self.value = first, term, value
        self.sizes = np.diff(first)
        self.weights, self.partners = weights, partners
        order = np.argsort(term, kind="stable")
        self.postings = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        self.lists = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.largest = np.zeros(len(weights), np.int64)
        np.maximum.at(self.largest, term, value)
        basis = np.random.default_rng(0).standard_normal((len(weights), PROJECTION), np.float32)
        points = np.zeros((len(self.sizes), PROJECTION), np.float32)
        there = self.sizes > 0
        if len(term):
            scaled = (value * weights[term]).astype(np.float32)[:, None] * basis[term]
            points[there] = np.add.reduceat(scaled, first[:-1][there], axis=0)
        self.points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-30)
        self._blocks: dict[int, tuple] = {}
        self._held = 0
        self._column = np.full(len(weights), -1)

    def blocks(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents of the list of ``t`` by block, the blocks' starts, and their summaries (a column for each partner term)."""
        found = self._blocks.get(t)
        if found is not None:
            return found
        docs = self.postings[self.lists[t] : self.lists[t + 1]]
        centres = docs[np.linspace(0, len(docs) - 1, math.isqrt(len(docs) - 1) + 1).astype(np.int64)]
        nearest = np.argmax(self.points[docs] @ self.points[centres].T, axis=1)
        order = np.argsort(nearest, kind="stable")
        docs, nearest = docs[order], nearest[order]
        starts = np.flatnonzero(np.append(True, nearest[1:] != nearest[:-1]))
        block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(docs))))
        self._column[self.partners[t]] = np.arange(len(self.partners[t]))
        places = _spread(self.first[docs], self.sizes[docs])
        column, owner = self._column[self.term[places]], np.repeat(block, self.sizes[docs])
        self._column[self.partners[t]] = -1
        summary = np.zeros((len(starts), len(self.partners[t])), np.int32)
        np.maximum.at(summary, (owner[column >= 0], column[column >= 0]), self.value[places][column >= 0].astype(np.int32))
        if self._held + summary.nbytes > SUMMARY_BYTES:
            self._blocks.clear()
            self._held = 0
        self._held += summary.nbytes
        self._blocks[t] = docs, starts, summary
        return self._blocks[t]

    def scores(self, docs: np.ndarray, mine: np.ndarray) -> np.ndarray:
        places = _spread(self.first[docs], self.sizes[docs])
        return np.add.reduceat(mine[self.term[places]] * self.value[places], np.append(0, np.cumsum(self.sizes[docs])[:-1]))

    def search(self, terms: np.ndarray, least: int, k: int, mine: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a score of at least ``least`` (and above 0) that may be among the ``k`` best, and their scores.

        ``mine`` (zeros, one per term) and ``seen`` (false, one per document) are work space, left as they were.
        """
        bound = self.weights[terms] * self.largest[terms]
        order = np.argsort(-bound, kind="stable")
        terms, bound = terms[order][bound[order] > 0], bound[order][bound[order] > 0]
        rest = np.cumsum(bound[::-1])[::-1]
        mine[terms] = self.weights[terms]
        docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        best = np.zeros(0, np.int64)
        for i, t in enumerate(terms):
            if rest[i] < least:
                break
            listed, starts, summary = self.blocks(t)
            columns = np.searchsorted(self.partners[t], terms[i:])
            bounds = summary[:, columns].astype(np.int64) @ self.weights[terms[i:]]
            ends = np.append(starts[1:], len(listed))
            turn = np.argsort(-bounds, kind="stable")
            at, step = 0, 1
            while at < len(turn) and bounds[turn[at]] >= least:
                some = turn[at : at + step]
                some = some[bounds[some] >= least]
                found = listed[_spread(starts[some], ends[some] - starts[some])]
                found = found[~seen[found]]
                seen[found] = True
                if len(found):
                    got = self.scores(found, mine)
                    docs.append(found)
                    scores.append(got)
                    best = np.append(best, got)
                    if len(best) >= k:
                        best = np.partition(best, len(best) - k)[len(best) - k :]
                        least = max(least, int(best.min()))
                at, step = at + step, 2 * step
        mine[terms] = 0
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        seen[docs] = False
        good = (scores >= least) & (scores > 0)
        return docs[good], scores[good]


def _top(rows: list[tuple[int, object]], k: int) -> list[tuple[int, object]]:
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[:k]


def _partners(terms: Terms) -> list[np.ndarray]:
    """For each term, all terms of the items that hold it."""
    together: list[list[np.ndarray]] = [[] for _ in terms.codes]
    for item in terms.items:
        for t in item:
            together[t].append(item)
    return [np.unique(np.concatenate(x)) for x in together]


def _searched(shared, k: int, n_docs: int, n_words: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, seeds = shared.value
        partners = _partners(terms)
        kept: list[list[tuple[int, object]]] = [[] for _ in terms.items]
        mine = np.zeros(len(weights), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_DOCS):
                part = batch.slice(at, CHUNK_DOCS)
                lists, counts = part.column("terms"), part.column("counts").flatten().to_numpy().astype(np.int64)
                first = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy())).astype(np.int64)
                m = 50 + (50 * part.column("n").to_numpy().astype(np.int64) * n_docs) // n_words
                value = (1_000_000_000 * counts) // (1000 * counts + 20 * np.repeat(m, np.diff(first)))
                chunk = Chunk(first, lists.flatten().to_numpy().astype(np.int64), value, weights, partners)
                rank = np.empty(part.num_rows, np.int64)
                rank[pc.sort_indices(part.column("doc_id")).to_numpy()] = np.arange(part.num_rows)
                ids, seen = part.column("doc_id"), np.zeros(part.num_rows, bool)
                for i, item in enumerate(terms.items):
                    least = max(seeds[i], kept[i][-1][0] if len(kept[i]) == k else 0)
                    docs, scores = chunk.search(item, least, k, mine, seen)
                    order = np.lexsort((rank[docs], -scores))[:k]
                    new = [(int(s), ids[int(d)].as_py()) for d, s in zip(docs[order], scores[order])]
                    kept[i] = _top(kept[i] + new, k) if new else kept[i]
        rows = [(i, doc, score) for i, best in enumerate(kept) for score, doc in best]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), id_type, pa.int64()))]
        yield pa.RecordBatch.from_arrays(made, ["item", "doc_id", "score"])

    return run


def _item_blocks(items: DataFrame, limit: int) -> Iterator[list]:
    block, size = [], 0
    for row in items.toLocalIterator():
        more = len(row["text"].encode())
        if block and size + more > limit:
            yield block
            block, size = [], 0
        block.append(row)
        size += more
    if block:
        yield block


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each item, first among the rows of some tasks, then of all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("some", F.spark_partition_id() % 64)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "some").orderBy(*order))).where(F.col("rank") <= k).drop("some", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES, seed_docs: int = SEED_DOCS) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``k`` best documents of each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    source = docs.select("doc_id", "text")
    id_type = pa.schema(source.select("doc_id").limit(0).toArrow().schema).field(0).type
    kind, item_kind = source.dtypes[0][1], items.select("item_id").dtypes[0][1]
    named = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    path = None
    for block in _item_blocks(named, item_bytes):
        terms = terms_of([r["text"].encode() for r in block])
        if not len(terms.codes):
            continue
        path = path or scratch_path(spark, "ranking-results")
        place = scratch_path(spark, "ranking-index")
        source.mapInArrow(_index(spark.sparkContext.broadcast(terms)), f"doc_id {kind}, n bigint, terms array<int>, counts array<int>").write.parquet(place)
        index = spark.read.parquet(place)
        n_docs, n_words = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms.codes), np.int64)
        # One row per term of the block.
        for t, n in index.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[t] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)

        def search(part: DataFrame, seeds: list[int]) -> DataFrame:
            shared = spark.sparkContext.broadcast((terms, weights, seeds))
            return part.mapInArrow(_searched(shared, k, n_docs, max(n_words, 1), id_type), f"item int, doc_id {kind}, score bigint")

        seeds = [0] * len(block)
        if n_docs > seed_docs:
            few = index.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(n_docs // seed_docs)) == 0)
            full = _ranked(search(few, seeds), k).where(F.col("rank") == k)
            for r in full.select("item", "score").collect():
                seeds[r["item"]] = r["score"]
        best = _ranked(search(index, seeds), k)
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {item_kind}")
        best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
    schema = f"item_id {item_kind}, rank int, doc_id {kind}, score bigint"
    return spark.createDataFrame([], schema) if path is None else spark.read.schema(schema).parquet(path)


_WORDS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLDED}, {_WORDS}) AS w FROM documents),
sizes AS (SELECT r, doc_id, len(w)::BIGINT AS n, count(*) OVER () AS nd, sum(len(w)) OVER () AS l FROM docs WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY ALL),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLDED}, {_WORDS})) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + CAST((50 * n * nd) // l AS BIGINT))))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN df USING (term) JOIN sizes USING (r) GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
