"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content zstandard dictionary of at most ``DICTIONARY_BYTES``, cut from the texts of a sample of about
``SAMPLE_ROWS`` of its labelled rows. A text is folded, cut into blocks of ``BLOCK_BYTES``, and each block is compressed with every
dictionary; the sizes of all blocks are added up. A decision is rejected if the runner-up is less than ``MARGIN`` larger.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without a language take no part in the fit; ties go to the
first language by name; without any language every text is ``und``; rows are independent; an empty table gives an
empty table; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .text import slices

SAMPLE_ROWS = 96
DICTIONARY_BYTES = 192 << 10
BLOCK_BYTES = 4 << 10
MARGIN = 0.02
LEVEL = 3
_LETTERS = re.compile(r"[^\W\d_]+")


def _folded(text: str) -> bytes:
    """Lower-case runs of letters: marks and digits say little about the language."""
    return " ".join(_LETTERS.findall(text.lower())).encode()


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> tuple[tuple[str, bytes], ...]:
    """Language and dictionary of each ``lang`` of ``docs``.

    Every language gives the rows with the smallest hashes of id and text, in a share that makes about ``rows`` of its different ones (all, if it has fewer); of each, a part as
    long as its share of the dictionary, from a place that the hash gives.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text", F.lit(7)).alias("hash"))
    sizes = {r["lang"]: max(1, r["n"]) for r in known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    if not sizes:
        return ()
    shares = {lang: min(1 << 30, (rows << 30) // n) for lang, n in sizes.items()}
    limit = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    part = max(1, dictionary_bytes // rows)
    spare = F.greatest(F.length("text") - part, F.lit(0))
    picked = known.where(F.pmod("hash", F.lit(1 << 30)) < limit)
    picked = picked.select("lang", "hash", F.expr("text").substr((F.pmod(F.shiftright("hash", 30), spare + 1) + 1).cast("int"), F.lit(part)).alias("text"))
    # Rows that are given several times have one hash, and count once.
    picked = picked.dropDuplicates(["lang", "hash"])
    texts: dict[str, list[bytes]] = {lang: [] for lang in sizes}
    for r in picked.orderBy("hash", "text").collect():
        texts[r["lang"]].append(_folded(r["text"]))
    return tuple((lang, b" ".join(texts[lang])[:dictionary_bytes]) for lang in sorted(texts))


@lru_cache(maxsize=2)
def _compressors(languages: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    made = []
    for _, content in languages:
        # zstandard takes less than 8 bytes for no dictionary.
        data = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False))
    return made


def _sizes(text: str, compressors: list) -> list[int]:
    raw = _folded(text)
    blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def identify(docs: DataFrame, languages: tuple[tuple[str, bytes], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``lang_pred``, ``score`` (how much smaller than the runner-up, 0 to 1) and ``rejected`` (narrow margin)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(text_col).rlike(r"\p{L}").alias("letters"))
    shared = rows.sparkSession.sparkContext.broadcast(languages)
    names = [lang for lang, _ in languages]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(shared.value)
        for part in slices(batches, "text"):
            best, score = [], np.zeros(part.num_rows)
            for k, (text, letters) in enumerate(zip(part.column("text").to_pylist(), part.column("letters").to_pylist())):
                if not letters or not names:
                    best.append("und")
                    continue
                sizes = _sizes(text, compressors)
                first = int(np.argmin(sizes))
                best.append(names[first])
                second = min((s for i, s in enumerate(sizes) if i != first), default=None)
                score[k] = 1.0 if second is None else 1.0 - sizes[first] / second
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(best, pa.string()), pa.array(score), pa.array(score < MARGIN)],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, lang_pred string, score double, rejected boolean")
