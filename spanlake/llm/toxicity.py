"""Toxicity: a linear classifier on hashed character n-grams, scaled by naive Bayes log-count ratios.

Each text is a set of n-grams of its folded words. ``r`` of an n-gram is the log of its document frequency among toxic rows over that
among the others. A logistic regression is fitted on the n-grams that tell the classes apart, each with value ``r``.

The fit reads at most ``SAMPLE_ROWS`` labelled rows (the first by a hash of their id): their document frequencies come to the
driver as eight fixed-size tables, then the sets of chosen n-grams. Scoring is one narrow step over all rows and whole texts.

Defined cases: a null text is empty and gets the score of a text without n-grams; labels other than 0 and 1 and null ids
take no part; a label row given twice counts twice; without labels of both classes every score is the smoothed share of toxic labels (0.05 if
there are none); rows are independent; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import shared_dir
from .text import FOLD, as_bytes, mix, powers, prefix_hash, slices

SAMPLE_ROWS = 6144
GRAMS = (4, 5, 6)
DIM_BITS = 20
FEATURES = 1 << 14
THRESHOLD = 0.3
TABLES = 8
#: Text bytes of one numpy round: an n-gram of each size begins at every byte, and each takes some 60 bytes on the way.
GRAM_BYTES = 1 << 19
_DIM = 1 << DIM_BITS


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and slot of each n-gram occurrence."""
    folded = [b" " + b" ".join(t.translate(FOLD).split()) + b" " for t in texts]
    sizes = np.array([len(f) for f in folded], np.int64)
    buf = np.frombuffer(b"".join(folded), np.uint8)
    text = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(buf))
    c, inverse = prefix_hash(buf), powers(len(buf), inverse=True)
    texts_of, slots = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        code = mix((c[at + n] - c[at]) * inverse[at] + np.uint64(n))
        texts_of.append(text[at])
        slots.append((code >> np.uint64(64 - DIM_BITS)).astype(np.int64))
    return np.concatenate(texts_of), np.concatenate(slots)


@dataclass
class Model:
    """``number`` maps a slot to a chosen feature or -1; ``weight`` is coefficient times ratio."""

    number: np.ndarray
    weight: np.ndarray
    bias: float

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) pairs."""
        text, slot = _grams(texts)
        feature = self.number[slot].astype(np.int64)
        known = feature >= 0
        pair = np.unique(text[known] * FEATURES + feature[known])
        return pair // FEATURES, pair % FEATURES

    def score(self, texts: list[bytes]) -> np.ndarray:
        text, feature = self.features(texts)
        z = self.bias + np.bincount(text, self.weight[feature], len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def held_out(id_col: Column) -> Column:
    """The quarter of the rows that no fit sees."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled texts, fixed by a checkpoint; repeated rows count once."""
    shared_dir(docs.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct()
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    texts = docs.select("doc_id", "text")
    # At most ``rows`` rows are broadcast. An id may have several texts, so the bound is applied to these as well.
    found = texts.join(F.broadcast(known), "doc_id").distinct()
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("text"), "text").limit(rows)
    return found.select("label", "text").repartition(TABLES).checkpoint()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros((2, _DIM), np.int64), np.zeros(2, np.int64)
    for part in slices(batches, "text", GRAM_BYTES):
        label = part.column("label").to_numpy()
        text, slot = _grams(as_bytes(part.column("text")))
        pair = np.unique(text * _DIM + slot)
        for y in (0, 1):
            counts[y] += np.bincount(pair[label[pair // _DIM] == y] % _DIM, minlength=_DIM)
        rows += np.bincount(label, minlength=2)
    if rows.sum():
        table = [zlib.compress(c.astype(np.uint32).tobytes(), 1) for c in counts]
        yield pa.RecordBatch.from_pydict({"n0": [rows[0]], "n1": [rows[1]], "c0": [table[0]], "c1": [table[1]]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    sample = training_rows(docs, labels, min(rows, 65_535))
    n, df = np.zeros(2), np.zeros((2, _DIM))
    for row in sample.mapInArrow(_frequencies, "n0 bigint, n1 bigint, c0 binary, c1 binary").collect():
        n += (row.n0, row.n1)
        df += [np.frombuffer(zlib.decompress(c), np.uint32) for c in (row.c0, row.c1)]
    prior = (n[1] + 0.1) / (n.sum() + 2)
    empty = Model(np.full(_DIM, -1, np.int16), np.zeros(FEATURES), float(np.log(prior / (1 - prior))))
    if not n.all():
        return empty
    share = df / n[:, None]
    both = df.sum(0) / n.sum()
    spread = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n[0] + 1 / n[1]))
    tells = np.where(df.sum(0) >= 3, np.abs(share[1] - share[0]) / spread, 0)
    chosen = np.sort(np.argsort(-tells, kind="stable")[:FEATURES])
    chosen = chosen[tells[chosen] > 4]
    number = empty.number.copy()
    number[chosen] = np.arange(len(chosen), dtype=np.int16)
    ratio = np.zeros(FEATURES)
    ratio[: len(chosen)] = np.log((df[1, chosen] + 1) / (n[1] + 2)) - np.log((df[0, chosen] + 1) / (n[0] + 2))
    model = Model(number, ratio, empty.bias)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", GRAM_BYTES):
            text, feature = shared.value.features(as_bytes(part.column("text")))
            bounds = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("label"), lists], ["label", "features"])

    data = sample.mapInArrow(sets, "label int, features array<int>").collect()
    label = np.array([r.label for r in data], float)
    row = np.repeat(np.arange(len(data)), [len(r.features) for r in data])
    feature = np.array([f for r in data for f in r.features], np.int64)
    coefficient, bias = _logistic(row, feature, ratio, label)
    return Model(number, coefficient * ratio, bias)


def _logistic(row: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the ridge-penalised log loss; feature ``f`` of a row has the value ``value[f]``."""
    n, x = len(label), value[feature]
    w, b = np.zeros(len(value)), 0.0
    v = np.random.default_rng(0).normal(size=len(value))
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        v = np.bincount(feature, np.bincount(row, v[feature] * x, n)[row] * x, len(value))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 1.0 / (0.3 * (top + n) + ridge)
    w0, b0 = w, b
    for k in range(1, 601):
        momentum = (k - 1) / (k + 2)
        wy, by = w + momentum * (w - w0), b + momentum * (b - b0)
        error = 1 / (1 + np.exp(-np.clip(by + np.bincount(row, wy[feature] * x, n), -40, 40))) - label
        w0, b0 = w, b
        w = wy - step * (np.bincount(feature, error[row] * x, len(value)) + ridge * wy)
        b = by - step * error.sum()
    return w, float(b)


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row with its ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep]
    carried = names if text_col in names else [*names, text_col]
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, GRAM_BYTES):
            score = shared.value.score(as_bytes(part.column(text_col)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(score)], [*names, "score"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "score double"])
    return docs.select(*carried).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns."""
    names = docs.columns
    own = [f"_c{i}" for i in range(len(names))]
    scored = score_texts(docs.toDF(*own), model, own[names.index("text")], tuple(own))
    return scored.where(F.col("score") < threshold).select(*[F.col(o).alias(c) for o, c in zip(own, names)])
