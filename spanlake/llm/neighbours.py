"""Approximate nearest neighbours by cosine, with balanced posting lists.

Unit vectors are clustered into lists. A vector goes to its nearest centroid and also to others that are nearly as near (boundary
vectors), unless a centroid chosen before is nearer to that centroid than the vector is. Queries walk a neighbour graph of the centroids and search the lists
whose distance is at most a ratio times the nearest one's; the ratio is the least that finds ``AIM`` of the true neighbours of ``PROBES`` sample vectors
in the sample. Where these lists hold fewer than ``k`` other ids, the next nearest ones are searched, too. Lists of more than ``BLOCK_ROWS`` rows are dealt to several blocks, and a query
visits all blocks of its lists, so a hot list costs many tasks little. A block keeps the best ``k`` of each query; the final order is by
cosine on the original vectors in double precision.

The centroids are fitted on at most ``SAMPLE_ROWS`` vectors (the first by a hash of their id); every vector is indexed.

Defined cases: vectors that are null, zero, of another length than most vectors of the sample, or hold null or non-finite components take no part; ties go to
the smaller id; rows of one id are one vector with several places: a pair of ids has the best score of its rows, and a query skips all rows of its own id; with fewer than ``k`` other ids in the table it gets all of them;
below ``EXACT_ROWS`` sample vectors there is one list, which holds all; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_dir

SAMPLE_ROWS = 16_384
EXACT_ROWS = 256
LISTS = 256
REPLICAS = 2
BOUNDARY = 1.05
AIM = 0.98
PROBES = 256
GRAPH_DEGREE = 24
BEAM = 64
BLOCK_ROWS = 4096


@dataclass
class Index:
    """Unit centroids and, for each, its nearest centroids."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _balanced_clusters(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids of k-means whose assignment costs more for lists that are above their share."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), lists, replace=False)]
    penalty = np.zeros(lists)
    for _ in range(rounds):
        near = np.argmax(x @ centroids.T - penalty, axis=1)
        size = np.bincount(near, minlength=lists)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        empty = norm < 1e-12
        centroids = np.where(empty[:, None], x[rng.choice(len(x), lists)], total / np.maximum(norm, 1e-12)[:, None])
        penalty = np.clip(penalty + 0.02 * (size / (len(x) / lists) - 1), 0, 0.2)
    return _unit(centroids)


def build_index(sample: np.ndarray, lists: int = LISTS) -> Index:
    distinct = np.unique(_unit(sample.astype(float)), axis=0)
    lists = 1 if len(distinct) < EXACT_ROWS else min(lists, len(distinct) // 64)
    centroids = _balanced_clusters(distinct, lists)
    graph = np.argsort(_distances(centroids, centroids), axis=1, kind="stable")[:, 1 : GRAPH_DEGREE + 1]
    entries = np.arange(0, lists, max(1, lists // 16))
    return Index(centroids, graph, entries)


def search_graph(index: Index, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (nearest first) and distances that a best-first walk over the graph finds for each row of ``x``.

    All rows move in step: each expands its nearest centroid that is not expanded yet, until its ``beam`` nearest all are.
    """
    n, lists = len(x), len(index.centroids)
    beam = min(beam, lists)
    distance = np.full((n, lists), np.inf)
    expanded = np.zeros((n, lists), bool)
    distance[:, index.entries] = _distances(x, index.centroids[index.entries])
    rows = np.arange(n)
    while len(rows) and index.graph.shape[1]:
        d = distance[rows]
        limit = np.partition(d, beam - 1, axis=1)[:, beam - 1]
        open_d = np.where(expanded[rows], np.inf, d)
        pick = np.argmin(open_d, axis=1)
        best = open_d[np.arange(len(rows)), pick]
        go = (best <= limit) & np.isfinite(best)
        rows, pick = rows[go], pick[go]
        expanded[rows, pick] = True
        near = index.graph[pick]
        distance[rows[:, None], near] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("nd,nkd->nk", x[rows], index.centroids[near])))
    order = np.argsort(distance, axis=1, kind="stable")[:, :beam]
    return order, np.take_along_axis(distance, order, axis=1)


def posting_lists(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and list of every copy of a vector: its nearest list, and boundary lists."""
    order, distance = search_graph(index, x, 16)
    row, lists = [np.arange(len(x))], [order[:, 0]]
    chosen = np.zeros(order.shape, bool)
    chosen[:, 0] = True
    for k in range(1, order.shape[1]):
        fits = (distance[:, k] <= BOUNDARY * distance[:, 0]) & (chosen.sum(axis=1) < REPLICAS)
        for j in range(k):
            between = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("nd,nd->n", index.centroids[order[:, k]], index.centroids[order[:, j]])))
            fits &= ~(chosen[:, j] & (between < distance[:, k]))
        chosen[:, k] = fits
        row.append(np.flatnonzero(fits))
        lists.append(order[fits, k])
    return np.concatenate(row), np.concatenate(lists)


def fit_ratio(index: Index, x: np.ndarray, k: int, aim: float = AIM) -> float:
    """The ratio that reaches the share ``aim`` of the ``k`` nearest of some rows of ``x`` among all of them."""
    x = np.unique(x, axis=0)
    row, lists = posting_lists(index, x)
    asked = np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int)
    nearness = x[asked] @ x.T
    nearness[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-nearness, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    order, distance = search_graph(index, x[asked], len(index.centroids))
    by_list = np.empty_like(distance)
    np.put_along_axis(by_list, order, distance / np.maximum(distance[:, :1], 1e-12), axis=1)
    held = np.argsort(row, kind="stable")
    bounds = np.searchsorted(row[held], np.arange(len(x) + 1))
    needed = [by_list[i, lists[held[bounds[j] : bounds[j + 1]]]].min() for i in range(len(asked)) for j in best[i]]
    return float(np.quantile(needed, aim, method="higher")) if needed else 1.0


def probed_lists(index: Index, x: np.ndarray, ratio: float, held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and list of every list that a query searches: those within the ratio, and the next nearest until all hold ``least`` ids.

    ``held`` has the ids of each list, each id counted in one list only.
    """
    order, distance = search_graph(index, x, len(index.centroids))
    before = np.cumsum(held[order], axis=1) - held[order]
    asked = (distance <= ratio * distance[:, :1] + 1e-12) | (before < least)
    return np.nonzero(asked)[0], order[asked]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _spread(shared, how):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                row, lists = how(shared.value, _unit(_matrix(part.column("vector"))))
                part = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), part.column("vec_id"), part.column("vector")], ["list", "vec_id", "vector"])

    return run


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, each computed alike wherever the pair stands."""
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def _distinct(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows that differ in id or vector."""
    if not rows["vec_id"].duplicated().any():
        return rows
    return rows[~pd.DataFrame({"vec_id": rows["vec_id"], "raw": [np.asarray(v, float).tobytes() for v in rows["vector"]]}).duplicated()]


def _best_in_block(k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows, queries = _distinct(rows).sort_values("vec_id", kind="stable"), _distinct(queries)
        q, x = np.stack(queries["vector"]).astype(float), np.stack(rows["vector"]).astype(float)
        ids, own = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        out = []
        unit = _unit(x).T
        heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        for start in range(0, len(q), 512):
            part = _unit(q[start : start + 512]) @ unit
            part[own[start : start + 512, None] == ids[None, :]] = -np.inf
            # An id counts once, with the nearest of its vectors.
            by_id = part if len(heads) == len(ids) else np.maximum.reduceat(part, heads, axis=1)
            least = np.partition(by_id, max(0, by_id.shape[1] - k), axis=1)[:, max(0, by_id.shape[1] - k)]
            # Everything that rounding could put among the best; exact scores decide, ties by id.
            at, of = np.nonzero((part >= least[:, None] - 1e-9) & np.isfinite(part))
            at = at + start
            score = _cosines(q[at], x[of])
            found = pd.DataFrame({"query_id": own[at], "vec_id": ids[of], "score": score}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            out.append(found.drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k))
        return pd.concat(out)

    return run


def _usable(vector: Column) -> Column:
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda v: v != 0)


def nearest(
    vectors: DataFrame,
    is_query: str,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    lists: int = LISTS,
    ratio: float | None = None,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest vectors of each row that meets ``is_query`` (on ``vec_id``)."""
    spark = vectors.sparkSession
    shared_dir(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(_usable(F.col("vector")) & F.col("vec_id").isNotNull())
    schema = "list int, vec_id bigint, vector array<double>"
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").toPandas()["vector"]
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    lengths = sample.map(len).value_counts()
    length = int(lengths.index[lengths == lengths.max()].min())
    rows = rows.where(F.size("vector") == length)
    sample = _unit(np.stack([v for v in sample if len(v) == length]))
    index = build_index(sample, lists)
    ratio = fit_ratio(index, sample, k) if ratio is None else ratio
    shared = spark.sparkContext.broadcast(index)
    postings = rows.mapInArrow(_spread(shared, posting_lists), schema).checkpoint()
    # At most LISTS rows. Copies of a vector and repeated ids count once, so what the searched lists hold is not counted too high.
    counted = postings.groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count().collect()
    held = np.zeros(len(index.centroids), np.int64)
    for row in counted:
        held[row["list"]] = row["count"]
    # The query itself is one of the ids.
    queries = rows.where(is_query).mapInArrow(_spread(shared, lambda i, x: probed_lists(i, x, ratio, held, k + 1)), schema)
    sizes = postings.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    # At most LISTS rows.
    sizes = F.broadcast(sizes)
    dealt = postings.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("bigint")).cast("int"))
    asked = queries.join(sizes, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keep = ("list", "block", "vec_id", "vector")
    found = (
        asked.select(*keep)
        .groupBy("list", "block")
        .cogroup(dealt.select(*keep).groupBy("list", "block"))
        .applyInPandas(_guarded(_best_in_block(k)), "query_id bigint, vec_id bigint, score double")
    )
    # A query has at most k rows of each block it searched; a replicated vector comes from several lists.
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(place).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _guarded(best):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return best(key, queries, rows)

    return run
