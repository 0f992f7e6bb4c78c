"""SentencePiece encoding and decoding with vectorised merge rounds.

A text becomes ``▁`` plus the text with blanks as ``▁``. No piece of a supported vocabulary has ``▁`` after another
character or a newline, so merges never cross from a character to ``▁`` or a newline: those are the word bounds. Each task encodes each
distinct word once. All new words of a batch are one flat symbol array; in each round every word finds its smallest pair
rank (segmented minimum) and merges its leftmost pairs of that rank, and the array is compacted, until no pair remains.

A rank is *plain* if a symbol it makes can only take part in pairs of larger rank: then all its pairs in a word merge in one round. Otherwise
a pair waits for the next round if a pair before it makes a symbol that has to merge sooner. Words of more than 400 characters look at
neighbourhoods instead of the whole word, so that the number of rounds does not grow with them. Runs of ``▁`` that are left at the end
are cut as merging them from the left does, since they share the last rank; the cuts repeat with the longest run.

Defined cases: null is empty; an empty text has the end id only (if asked for) and decodes to the empty text; characters
outside the vocabulary become byte pieces; bytes that are not UTF-8 decode to U+FFFD each; rows are independent; other columns
of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from sys import getsizeof

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .text import slices

SPACE = "▁"
#: Bytes of distinct words and their ids that a task remembers before it starts anew.
MEMORY = 64 << 20
#: Bytes that a remembered word takes beside its own: an entry of the table, a number and a bound.
_ENTRY = 160
#: Characters of a word beyond which merging looks at neighbourhoods, not at the whole word.
LONG = 400
_WORD = re.compile(" *[^ \n]+|\n| +")
_NONE = np.int64(1) << 60


def _around(rank: np.ndarray, reach: int) -> np.ndarray:
    """The least rank among ``reach`` places on both sides."""
    padded = np.concatenate((np.full(reach, _NONE), rank, np.full(reach, _NONE)))
    width, span = 2 * reach + 1, 1
    while span * 2 <= width:
        padded = np.minimum(padded[:-span], padded[span:])
        span *= 2
    rest = width - span
    return np.minimum(padded[: len(rank)], padded[rest : rest + len(rank)])


class Vocabulary:
    """Pieces, pair table and byte pieces of a model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.piece = [model.id_to_piece(i) for i in range(n)]
        self.control = {i for i in range(n) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.end = model.eos_id()
        self.byte_of = {i: int(self.piece[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        special = self.control | set(self.byte_of) | {self.unknown}
        self.id_of = {p: i for i, p in enumerate(self.piece) if i not in special}
        scores = {i: model.get_score(i) for i in self.id_of.values()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self._check(model, scores)
        rank = {i: order[s] for i, s in scores.items()}
        pairs = [
            (self.id_of[p[:k]], self.id_of[p[k:]], i)
            for p, i in self.id_of.items()
            for k in range(1, len(p))
            if not p.startswith(SPACE * 2) and p[:k] in self.id_of and p[k:] in self.id_of
        ]
        pairs.sort()
        self.n = n
        self.pair_key = np.array([a * n + b for a, b, _ in pairs], np.int64)
        self.pair_piece = np.array([i for _, _, i in pairs], np.int64)
        self.pair_rank = np.array([rank[i] for _, _, i in pairs], np.int64)
        early = np.zeros(len(order) + 1, bool)
        for a, b, i in pairs:
            for part in (a, b):
                if rank[i] <= rank[part]:
                    early[rank[part]] = True
        self.plain = ~early
        self.reach = 2 * max((len(p) for p in self.id_of), default=1)

    def _check(self, model, scores: dict[int, float]) -> None:
        """Refuse vocabularies on which the word bounds or the last step would be wrong."""
        runs = {len(p) for p in self.id_of if set(p) == {SPACE}}
        rest = [s for i, s in scores.items() if len(self.piece[i]) > 1 and set(self.piece[i]) != {SPACE}]
        tied = {scores[self.id_of[SPACE * m]] for m in runs if m > 1}
        letters = {c for p in self.id_of for c in p}
        fine = (
            len(self.byte_id) == 256
            and all(SPACE not in p.lstrip(SPACE) and "\n" not in p for p in self.id_of)
            and not any(p.startswith(SPACE * 2) and set(p) != {SPACE} for p in self.id_of)
            and 1 in runs
            and len(tied) <= 1
            and all(s > max(tied, default=float("-inf")) for s in rest)
            and letters <= set(self.id_of)
            and model.encode("  ﬁ a ") == model.encode(f"{SPACE} ﬁ a{SPACE}")
            and model.decode(model.encode("  ﬁ a ")) == "  ﬁ a "
        )
        if not fine:
            raise ValueError("this model needs another normaliser or other word bounds")
        self.longest_run = most = max(runs)
        self._cuts = [_cut(m, runs) for m in range(4 * most)]
        if any(self._cuts[m + most] != [most, *self._cuts[m]] for m in range(most, 3 * most)):
            raise ValueError("runs of blanks have no period in this model")

    def cut(self, length: int) -> list[int]:
        """Lengths of the pieces that a run of ``length`` blanks ends in."""
        whole = max(0, length // self.longest_run - 2)
        return [self.longest_run] * whole + self._cuts[length - whole * self.longest_run]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's ids begin (one more bound at the end)."""
        flat = "".join(words)
        code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, which = np.unique(code, return_inverse=True)
        # A character without a piece has a number below 0; it is spelled in bytes at the end.
        known = np.array([self.id_of.get(chr(c), -1 - int(c)) for c in chars], np.int64)
        symbol = known[which]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbol, done_word, done_at = [], [], []
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.arange(len(symbol))
        long = np.repeat(size > LONG, size)
        done = [self._merge(symbol[part], word[part], at[part], reach) for part, reach in ((~long, None), (long, self.reach))]
        symbol, word, at = (np.concatenate(columns) for columns in zip(*done))
        order = np.argsort(at, kind="stable")
        return self._spell(symbol[order], word[order], len(words))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and pieces of pairs of symbols; what is no pair has the last rank."""
        key = left * self.n + right
        place = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        ok = (self.pair_key[place] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.pair_rank[place], _NONE), self.pair_piece[place]

    def _merge(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray, reach: int | None) -> tuple[np.ndarray, ...]:
        """Merge until no pair remains. A pair is ripe if its rank is the least of its word, or of ``reach`` symbols on both sides.

        A merge can only set off merges that contain it, so it changes nothing beyond the longest piece; ``reach`` is twice that.
        """
        out: tuple[list, list, list] = ([], [], [])
        while len(symbol):
            first = np.append(True, word[1:] != word[:-1])
            rank, piece = self._pairs(symbol, np.append(symbol[1:], -1))
            rank[:-1][first[1:]] = _NONE
            starts = np.flatnonzero(first)
            size = np.diff(np.append(starts, len(symbol)))
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < _NONE, size)
            if not live.all():
                for column, kept in zip((symbol, word, at), out):
                    kept.append(column[~live])
                symbol, word, at, rank, piece, first = (x[live] for x in (symbol, word, at, rank, piece, first))
                size, best = size[best < _NONE], best[best < _NONE]
                if not len(symbol):
                    break
            least = np.repeat(best, size) if reach is None else _around(rank, reach)
            ripe = (rank == least) & (rank < _NONE)
            # Overlapping pairs of one rank: each second one, from the left end of their run on.
            n = np.arange(len(rank))
            run = np.maximum.accumulate(np.where(first | np.append(True, rank[1:] != rank[:-1]), n, 0))
            before = np.cumsum(ripe) - ripe
            hit = np.flatnonzero(ripe & (before - before[run] == n - run) & ((n - run) % 2 == 0))
            apart = np.append(True, word[hit[1:]] != word[hit[:-1]])
            if reach is not None:
                apart |= np.append(True, np.diff(hit) > reach)
            # A pair waits if one before it makes a symbol that has to merge sooner.
            risky = np.flatnonzero(~self.plain[rank[hit]])
            if len(risky):
                h = hit[risky]
                merged = symbol.copy()
                merged[hit + 1] = piece[hit]
                left = np.where(first[h], -1, merged[h - 1])
                after = np.minimum(h + 2, len(symbol) - 1)
                right = np.where((h + 2 < len(symbol)) & (word[after] == word[h]), symbol[after], -1)
                sooner = np.zeros(len(hit), np.int64)
                sooner[risky] = np.minimum(self._pairs(left, piece[h])[0], self._pairs(piece[h], right)[0]) <= rank[h]
                before = np.cumsum(sooner) - sooner
                group = np.maximum.accumulate(np.where(apart, np.arange(len(hit)), 0))
                hit = hit[before == before[group]]
            symbol = symbol.copy()
            symbol[hit] = piece[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            symbol, word, at = symbol[keep], word[keep], at[keep]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)

    def _spell(self, symbol: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Join the runs of ``▁`` and spell unknown characters in bytes."""
        blank = self.id_of.get(SPACE, -1)
        run = symbol == blank
        if self.longest_run > 1 and (run[1:] & run[:-1] & (word[1:] == word[:-1])).any():
            starts = np.flatnonzero(run & ~np.append(False, run[:-1] & (word[1:] == word[:-1])))
            ends = np.flatnonzero(run & ~np.append(run[1:] & (word[1:] == word[:-1]), False)) + 1
            keep = np.ones(len(symbol), bool)
            symbol = symbol.copy()
            for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                keep[a:b] = False
                for length in self.cut(int(b - a)):
                    symbol[a], keep[a] = self.id_of[SPACE * length], True
                    a += length
            symbol, word = symbol[keep], word[keep]
        strange = np.flatnonzero(symbol < 0)
        if len(strange):
            spelled = {c: [self.byte_id[b] for b in chr(-1 - c).encode()] for c in np.unique(symbol[strange]).tolist()}
            size = np.ones(len(symbol), np.int64)
            size[strange] = [len(spelled[c]) for c in symbol[strange].tolist()]
            begin = np.cumsum(size) - size
            out = np.repeat(symbol, size)
            for c in spelled:
                places = begin[symbol == c]
                for k, b in enumerate(spelled[c]):
                    out[places + k] = b
            symbol, word = out, np.repeat(word, size)
        return symbol, np.searchsorted(word, np.arange(n_words + 1))

    @cached_property
    def _surface(self) -> tuple[np.ndarray, np.ndarray]:
        """Flat bytes of all pieces, and their bounds."""
        raw = [
            b"" if i in self.control else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode()
            for i, p in enumerate(self.piece)
        ]
        raw[self.unknown] = " ⁇ ".encode()
        return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))

    def decode_all(self, flat: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of flat ids. What is not plain (bytes that are not UTF-8, texts that begin with a byte piece) goes one by one."""
        surface, limits = self._surface
        begin, size = limits[flat], limits[flat + 1] - limits[flat]
        ends = np.cumsum(size)
        joined = surface[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cut = np.append(0, ends)[bounds].tolist()
        texts = []
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            lead = int(flat[bounds[k]]) if bounds[k] < bounds[k + 1] else self.end
            if self.piece[lead].startswith(SPACE):
                a += 1
            try:
                if lead in self.byte_of or lead in self.control and a < b:
                    raise UnicodeError
                texts.append(joined[a:b].decode())
            except UnicodeError:
                texts.append(self.decode(flat[bounds[k] : bounds[k + 1]].tolist()))
        return texts

    def decode(self, ids: list[int]) -> str:
        """The text of any sequence of ids."""
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i is None or i in self.control:
                continue
            piece = " ⁇ " if i == self.unknown else self.piece[i]
            if not any(out) and piece.startswith(SPACE):
                # Only the blank that encoding puts in front goes.
                out.append(piece[1:].replace(SPACE, " ") or "")
                if not out[-1]:
                    out[-1] = _MARK
                continue
            out.append(piece.replace(SPACE, " "))
        return "".join(x for x in out if x is not _MARK)


def _cut(length: int, runs: set[int]) -> list[int]:
    """Merge the leftmost mergeable pair of a run of single blanks until there is none."""
    out = [1] * length
    at = 0
    while at + 1 < len(out):
        if out[at] + out[at + 1] in runs:
            out[at : at + 2] = [out[at] + out[at + 1]]
            at = max(0, at - 1)
        else:
            at += 1
    return out


class _Mark(str):
    """An empty text that counts as one that is there."""

    def __bool__(self):
        return True


_MARK = _Mark("")


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


class Encoder:
    """A vocabulary with the words met so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.memory = 0
        self.ids = np.zeros(0, np.int32)
        self.bounds = np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the bounds of each text's ids."""
        if self.memory > MEMORY:
            self._clear()
        words = [_WORD.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        known = self.number
        new = list(dict.fromkeys(w for ws in words for w in ws if w not in known))
        if new:
            ids, bounds = self.vocabulary.encode_words([w.replace(" ", SPACE) for w in new])
            base = len(known)
            known.update((w, base + k) for k, w in enumerate(new))
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + bounds[1:]))
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
            self.memory += sum(map(getsizeof, new)) + _ENTRY * len(new) + 4 * len(ids)
        number = np.fromiter((known[w] for ws in words for w in ws), np.int64, sum(map(len, words)))
        begin = self.bounds[number]
        size = self.bounds[number + 1] - begin
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        of_text = np.append(0, np.cumsum([len(ws) for ws in words]))
        return flat, np.append(0, ends)[of_text]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(Vocabulary(path))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """Per row: ``ids`` of the text (with an end id if ``end``) and ``decoded``, the text that decoding them gives.

    ``model_path`` must be readable by every executor.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path)
        for part in slices(batches, "text"):
            flat, bounds = encoder.encode(part.column("text").to_pylist())
            if end:
                flat = np.insert(flat, bounds[1:], encoder.vocabulary.end)
                bounds = bounds + np.arange(len(bounds))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32))),
                    pa.array(encoder.vocabulary.decode_all(flat, bounds), pa.string()),
                ],
                ["doc_id", "ids", "decoded"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, ids array<int>, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
