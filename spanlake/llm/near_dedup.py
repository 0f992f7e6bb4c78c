"""Near-duplicate classes by DartMinHash: sparse weighted signatures, banded joining, exact check, connected components.

Elements of a text are its distinct runs of five words (a text of fewer words is one run). An element of weight ``w`` owns the region
``[0, w) x [0, rank bound)``; darts fall on it as a Poisson process that depends on the element alone. The bound is chosen for each
text so that about ``K (ln K + 4)`` darts fall on all its elements; each dart belongs to one of ``K`` coordinates, and the earliest dart of each
coordinate is its signature. Where a coordinate stays empty, the bound is doubled. Two texts agree in a coordinate with a probability equal
to their weighted Jaccard similarity. With 28 bands of 6 coordinates a pair of similarity 0.8 meets in a band with probability 0.9998.

In each bucket of a band the texts are compared with one centre, the member that meets the most others in all its buckets. Then links make
components. A bucket whose other members are of one component is done. Of all others every member, linked or not, goes on to finer bands (64 of 10
coordinates), where a bucket takes centres from its smallest components, 16 in the first round and twice as many in each next one, and compares them with all
members of other components, until the members that were no centre yet are of one component. So no pair that meets in a fine bucket is left out unless links join
it already, copies and clusters cost their size, and unlike texts that share a passage rarely meet again. Sizes and two bits of each of the 640 fine coordinates tell
unlike pairs apart before their texts move: a pair of similarity 0.8 is seen to differ in 96 coordinates on average, and one of more than 150 (a similarity of about 0.69) is not
compared (a pair of 0.8 is lost with a probability below 1e-8). A pair that meets in several fine buckets is compared in the one of the first band; bands are told equal by 20 bits of their
keys, so a pair of similarity 0.8 is lost to an equal looking band before its first with a probability of about 1e-5.
Similarity is checked exactly on the texts. Only texts that differ are compared: copies are one node from the start.

Defined cases: null texts and texts without words are in classes of their own; rows of equal text share a class, whatever their id; the class id
is the smallest ``doc_id`` of the class (null if it has none); repeated rows give repeated results; an empty
table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import scratch_path
from .components import connected_components
from .text import as_bytes, mix, slices, split_words, word_codes

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 28
ROWS = 6
#: Finer bands for what the first round leaves, and the centres of a bucket in the first of its rounds.
FINE_BANDS = 64
FINE_ROWS = 10
CENTRES = 16
#: Bits kept of each fine coordinate, and of the key of each fine band.
COORDINATE_BITS = 2
BAND_BITS = 20
#: Rows of ids and digests (some 40 bytes each) that are sent to all tasks.
SMALL = 100_000
#: Text bytes of one numpy round.
KEY_BYTES = 1 << 19
#: Text bytes of one numpy round with fine bands.
FINE_BYTES = 1 << 17
_STEP = np.uint64(0x9E3779B97F4A7C15)


def elements(texts: list[bytes], weighted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, code and weight (1, or occurrences) of the distinct runs of five words, sorted by text and code."""
    words = split_words(texts)
    codes = word_codes(words) if len(words.starts) else np.zeros(0, np.uint64)
    size = np.diff(words.first)
    n = np.maximum(np.minimum(size, 1), size - SHINGLE + 1)
    text = np.repeat(np.arange(len(texts)), n)
    at = words.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    left = words.first[text + 1] - at
    code = np.zeros(len(text), np.uint64)
    for k in range(SHINGLE):
        there = left > k
        code[there] = mix((code[there] + codes[at[there] + k]) * _STEP)
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    starts = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (code[1:] != code[:-1]))) if len(text) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(text)))
    return text[starts], code[starts], counts.astype(float) if weighted else np.ones(len(starts))


def _darts(text: np.ndarray, code: np.ndarray, weight: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, dart and rank of every dart that falls on ``[0, weight) x [0, bound[text])``."""
    strips = np.ceil(weight).astype(np.int64)
    owner = np.repeat(np.arange(len(text)), strips)
    strip = np.arange(len(owner)) - np.repeat(np.cumsum(strips) - strips, strips)
    unit = mix(code[owner] + strip.astype(np.uint64) * _STEP)
    width = np.minimum(1.0, weight[owner] - strip)
    of, rank, nth = text[owner], np.zeros(len(owner)), np.zeros(len(owner), np.int64)
    found: list[tuple] = []
    while len(unit):
        # Gaps between the ranks of the darts on one strip are exponential; take about as many as will fit.
        left = bound[of] - rank
        n = np.maximum(1, (left + np.sqrt(left)).astype(np.int64))
        begin = np.cumsum(n) - n
        row = np.repeat(np.arange(len(unit)), n)
        k = nth[row] + np.arange(len(row)) - begin[row]
        dart = mix(unit[row] + (k.astype(np.uint64) + np.uint64(1)) * _STEP)
        gap = -np.log1p(-((dart >> np.uint64(11)).astype(float) / float(1 << 53)))
        total = np.cumsum(gap)
        at = rank[row] + total - (total[begin] - gap[begin])[row]
        inside = at < bound[of][row]
        hit = inside if np.all(width == 1.0) else inside & ((mix(dart + np.uint64(1)) >> np.uint64(11)).astype(float) / float(1 << 53) < width[row])
        found.append((of[row[hit]], dart[hit], at[hit]))
        last = begin + n - 1
        more = inside[last]
        rank, nth = at[last][more], (nth + n)[more]
        unit, of, width = unit[more], of[more], width[more]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def signatures(text: np.ndarray, code: np.ndarray, weight: np.ndarray, n_texts: int, k: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Dart of each coordinate for each text that has elements, and which texts these are."""
    total = np.bincount(text, weight, n_texts)
    out = np.zeros((n_texts, k), np.uint64)
    bound = np.divide(k * (np.log(k) + 4), total, out=np.zeros(n_texts), where=total > 0)
    open_texts = total > 0
    while open_texts.any():
        part = open_texts[text]
        of, dart, rank = _darts(text[part], code[part], weight[part], bound)
        slot = of * k + (mix(dart ^ _STEP) % np.uint64(k)).astype(np.int64)
        earliest = np.full(n_texts * k, np.inf)
        np.minimum.at(earliest, slot, rank)
        won = rank == earliest[slot]
        out.reshape(-1)[slot[won]] = dart[won]
        open_texts = open_texts & np.isinf(earliest.reshape(n_texts, k)).any(axis=1)
        bound = bound * 2
    return out, total > 0


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.shape[1] // bands
    key = np.zeros((len(signature), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = mix((key + signature[:, i::rows][:, :bands]) * _STEP)
    return key.view(np.int64)


def _node(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _keys(weighted: bool, bands: int, rows: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", limit):
            text, code, weight = elements(as_bytes(part.column("text")), weighted)
            sig, there = signatures(text, code, weight, part.num_rows, bands * rows)
            keys = band_keys(sig, bands)[there]
            bounds = np.append(0, np.cumsum(there * bands)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.reshape(-1)))
            size = pa.array(np.bincount(text, weight, part.num_rows).astype(float))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), size, lists], ["doc_id", "node", "size", "keys"])

    return run


_FINE = "node binary, size double, marks array<bigint>, bands array<bigint>, keys array<bigint>"


def _planes(values: np.ndarray, n: int) -> list[np.ndarray]:
    """One number for each of ``n`` low bits of the 64 values of each row: bit ``b`` is that of value ``b``."""
    at = [(values >> np.uint64(k) & np.uint64(1)).astype(np.uint8) for k in range(n)]
    return [np.packbits(x, axis=1, bitorder="little").view(np.int64) for x in at]


def _fine_keys(weighted: bool):
    """Keys of the fine bands, with the weight of all elements and some bits of each coordinate (one by one) and of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", FINE_BYTES):
            text, code, weight = elements(as_bytes(part.column("text")), weighted)
            sig, _ = signatures(text, code, weight, part.num_rows, FINE_BANDS * FINE_ROWS)
            keys = band_keys(sig, FINE_BANDS)
            marks = [x for i in range(FINE_ROWS) for x in _planes(sig[:, i::FINE_ROWS] >> np.uint64(40), COORDINATE_BITS)]
            lists = [np.hstack(marks), np.hstack(_planes(keys.view(np.uint64), BAND_BITS)), keys]
            size = pa.array(np.bincount(text, weight, part.num_rows))
            yield pa.RecordBatch.from_arrays([part.column("node"), size, *(pa.array(list(x), pa.list_(pa.int64())) for x in lists)], ["node", "size", "marks", "bands", "keys"])

    return run


def _differing() -> tuple[Column, Column]:
    """In how many fine coordinates the bits of two texts differ, and the bits of the bands whose keys differ."""
    apart = lambda name, k: F.get(name, F.lit(k)).bitwiseXOR(F.get(f"c_{name}", F.lit(k)))
    either = lambda cols: reduce(lambda x, y: x.bitwiseOR(y), cols)
    counts = [F.bit_count(either([apart("marks", i * COORDINATE_BITS + k) for k in range(COORDINATE_BITS)])) for i in range(FINE_ROWS)]
    return reduce(lambda x, y: x + y, counts), either([apart("bands", k) for k in range(BAND_BITS)])


def _most_differing(least: float) -> int:
    """Coordinates seen to differ that a pair of similarity ``least`` exceeds with a probability below 1e-8."""
    n, share = FINE_BANDS * FINE_ROWS, (1 - least) * (1 - 0.5**COORDINATE_BITS)
    tail, chance = 0.0, [comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(n + 1)]
    for k in range(n, 0, -1):
        tail += chance[k]
        if tail >= 1e-8:
            return k
    return 0


def similarities(left: list[bytes], right: list[bytes], weighted: bool = False) -> np.ndarray:
    """Exact weighted Jaccard similarity of each pair of texts."""
    n = len(left)
    text, code, weight = elements(left + right, weighted)
    total = np.bincount(text, weight, 2 * n)
    pair = text % n
    order = np.lexsort((text, code, pair))
    pair, code, weight = pair[order], code[order], weight[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (code[1:] == code[:-1]))
    shared = np.bincount(pair[both], np.minimum(weight[both], weight[both + 1]), n)
    union = total[:n] + total[n:] - shared
    return np.divide(shared, union, out=np.zeros(n), where=union > 0)


def _similar(weighted: bool, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "left", 1 << 20, "right"):
                like = similarities(as_bytes(part.column("left")), as_bytes(part.column("right")), weighted) >= least
                yield part.filter(pa.array(like)).select(["node", "centre"])

    return run


def _saved(df: DataFrame, name: str) -> DataFrame:
    """A compressed table in the shared folder: fixes the rows and cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _verified(pairs: DataFrame, texts: DataFrame, weighted: bool, least: float) -> DataFrame:
    """The pairs (node, centre) whose texts are similar."""
    pairs = pairs.select("node", "centre").distinct()
    # If few texts are met, only these move.
    met = pairs.select(F.explode(F.array("node", "centre")).alias("node")).distinct().checkpoint()
    texts = texts.join(F.broadcast(met), "node", "left_semi") if met.count() <= SMALL else texts
    pairs = pairs.join(texts.select("node", F.col("text").alias("left")), "node")
    pairs = pairs.join(texts.select(F.col("node").alias("centre"), F.col("text").alias("right")), "centre")
    return pairs.select("node", "centre", "left", "right").mapInArrow(_similar(weighted, least), "node binary, centre binary").checkpoint()


def near_links(rows: DataFrame, nodes: DataFrame, members: DataFrame, weighted: bool = False, least: float = SIMILARITY) -> list[DataFrame]:
    """Verified links (node, centre) of the buckets in ``members`` (key, node, size).

    ``rows`` has doc_id, node and text; ``nodes`` has the ``first_id`` of each node.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = _saved(members.join(sizes, "key"), "buckets")
    meets = shared.groupBy("node").agg(F.sum("n").alias("meets"))
    still = shared.join(meets, "node").select("key", "node", "size", "meets")
    # One text of each member of a shared bucket; only here do all texts move.
    wanted = meets.select(F.col("node").alias("_node")).join(nodes.select(F.col("node").alias("_node"), "first_id"), "_node")
    own = (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    wanted = _saved(rows.join(wanted, own).select("node", "text").dropDuplicates(["node"]), "texts")

    sized = F.least("size", "c_size") >= F.greatest("size", "c_size") * (least - 1e-9)
    centres = still.groupBy("key").agg(F.max(F.struct("meets", "node", "size")).alias("best"))
    centres = centres.select("key", F.col("best.node").alias("centre"), F.col("best.size").alias("c_size"))
    tests = still.join(centres, "key").where("node <> centre").checkpoint()
    links = [_verified(tests.where(sized), wanted, weighted, least)]
    roots = connected_components(links[0].toDF("a", "b")).toDF("node", "root")
    # The centre has met its whole bucket. Where its other members are of several components, all of them go on.
    rooted = tests.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    left = rooted.join(mixed, "key", "left_semi").select("node", "root").distinct()
    # Unlike texts that share a passage meet in many buckets, but in few of finer bands.
    fine = _saved(wanted.join(left.select("node"), "node", "left_semi").mapInArrow(_fine_keys(weighted), _FINE), "fine")
    told = fine.select("node", "size", "marks", "bands")
    still = fine.select("node", "keys").join(left, "node").select(F.posexplode("keys").alias("band", "key"), "node", "root", F.xxhash64("node").alias("turn"))
    order = ["members", "turn", "node"]
    first = Window.partitionBy("key").orderBy(*order)
    differing, other_bands = _differing()
    alike = differing <= _most_differing(least)
    # A pair is tested in the first band where it meets: it stays there, of different components, until one of the two is a centre.
    earlier = F.expr("~shiftleft(-1L, band)")
    once = (other_bands.bitwiseAND(earlier) == earlier) & (F.struct(*order) > F.struct(*(F.col(c).alias(x) for c, x in zip(("c_members", "c_turn", "centre"), order))))
    many = CENTRES
    while True:
        groups = still.groupBy("key", "root").agg(F.count("*").alias("members"))
        mixed = groups.groupBy("key").agg(F.count("*").alias("roots")).where("roots > 1").select("key")
        still = still.join(groups.join(mixed, "key", "left_semi"), ["key", "root"]).checkpoint()
        if still.isEmpty():
            return links
        centres = still.withColumn("place", F.row_number().over(first)).where(F.col("place") <= many).drop("place", "band").checkpoint()
        facing = centres.join(told, "node").withColumnsRenamed({"node": "centre", **{c: f"c_{c}" for c in ("root", "turn", "members", "size", "marks", "bands")}})
        tests = still.join(told, "node").join(facing, "key").where((F.col("root") != F.col("c_root")) & sized & once & alike)
        tests = tests.select("node", "centre", "root", "c_root").checkpoint()
        found = _verified(tests, wanted, weighted, least)
        links.append(found)
        joined = tests.join(found, ["node", "centre"]).select(F.col("root").alias("a"), F.col("c_root").alias("b"))
        moved = connected_components(joined).toDF("root", "new_root")
        still = still.drop("members").join(centres.select("key", "node"), ["key", "node"], "left_anti")
        still = still.join(moved, "root", "left").withColumn("root", F.coalesce("new_root", "root")).drop("new_root")
        many *= 2


def _classes(docs: DataFrame, id_col: str, text_col: str, weighted: bool, least: float) -> DataFrame:
    """``doc_id``, ``class_id``, ``node`` and ``root`` of every row; ``root`` tells classes apart and is null without words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("node", _node(F.coalesce("text", F.lit(""))))
    kind = rows.dtypes[0][1]
    base = _saved(rows.mapInArrow(_keys(weighted, BANDS, ROWS, KEY_BYTES), f"doc_id {kind}, node binary, size double, keys array<bigint>"), "signatures")
    worded = base.where(F.size("keys") > 0)
    nodes = worded.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    keyed = worded.groupBy("node").agg(F.first("keys").alias("keys"), F.first("size").alias("size"))
    members = keyed.select(F.explode("keys").alias("key"), "node", "size")
    links = near_links(rows, nodes, members, weighted, least)
    if not links:
        classes = nodes.select("node", F.col("first_id").alias("class_id"), F.col("node").alias("root"))
    else:
        edges = links[0]
        for more in links[1:]:
            edges = edges.unionByName(more)
        roots = connected_components(edges.toDF("a", "b"))
        rooted = nodes.join(roots.toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        ids = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
        classes = rooted.join(ids, "root").select("node", "class_id", "root")
    found = worded.select("doc_id", "node").join(classes, "node").select("doc_id", "class_id", "node", "root")
    alone = base.where(F.size("keys") == 0).select("doc_id", F.col("doc_id").alias("class_id"), "node", F.lit(None).cast("binary").alias("root"))
    return found.unionByName(alone)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weighted: bool = False, least: float = SIMILARITY
) -> DataFrame:
    """``doc_id``, ``class_id`` and ``node`` (digest of the text) of every row."""
    return _classes(docs, id_col, text_col, weighted, least).drop("root")


def keep_one(docs: DataFrame, weighted: bool = False, least: float = SIMILARITY) -> DataFrame:
    """One row of each class with all columns of ``docs``: the smallest ``doc_id`` (null last), then the smallest digest of the text, then of the row.

    Rows without words stay, each is a class of its own. Names of other columns do not matter.
    """
    found = _classes(docs, "doc_id", "text", weighted, least).where("root IS NOT NULL")
    # All but the joins with the documents is narrow. A text is in one class.
    places = found.groupBy("root", "doc_id", "node").agg(F.count("*").alias("n"))
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    best = places.groupBy("root").agg(F.min(at).alias("best"))
    placed = places.join(best, "root").withColumn("chosen", at == F.col("best"))
    placed = _saved(placed.where("NOT chosen OR n > 1").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), "chosen"), "places")
    # Columns by their places, so that no name matters. The texts move once, and only if the rows to go are too many to be sent to all tasks.
    names = [f"c{i}" for i in range(len(docs.columns))]
    own_id, own_text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    marked = docs.toDF(*names).withColumn("_own_node", _node(F.coalesce(own_text, F.lit(""))))
    same = own_id.eqNullSafe(F.col("_id")) & (F.col("_own_node") == F.col("_node"))
    kept = marked.join(placed, same, "left_anti").select(*names)
    again = placed.where("chosen")
    n = again.count()
    if n:
        # Of a chosen row that is given several times, one.
        again = F.broadcast(again) if n <= SMALL else again
        whole = F.struct(*names)
        again = marked.join(again, same, "left_semi").groupBy(own_id.alias("_id"), "_own_node").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("_row"))
        kept = kept.unionByName(again.select("_row.*"))
    return kept.toDF(*docs.columns)
