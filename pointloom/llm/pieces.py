"""Operator 7: SentencePiece encoding and decoding by batched Viterbi.

A word's segmentation is the one of greatest score sum over the model's pieces. Words not met before are
grouped by length and advance together, one numpy step for each end and piece length: the hashes of all
substrings come from prefix sums, are looked up among the sorted hashes of the pieces, and the maxima store
back pointers. Characters outside the vocabulary become byte pieces. In a long word (text without spaces) the
pieces of one length are looked up at all places together, and the maxima pass over the pieces found.

The only public model here was trained for merges; its scores are minus the merge ranks. Viterbi finds the
best segmentation under those scores, which can differ from what replaying the merges would give.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, table
from .tokens import vocabulary_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
UNUSED = -1e8
#: Words of up to LONG characters are encoded in batches and remembered, up to so many; longer ones alone.
WORDS_KEPT, LONG = 300_000, 200
BATCH_CELLS, CHUNK = 1 << 18, 1 << 16


class Pieces:
    """Vocabulary of a model, with a bounded memory of encoded words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        # runs of spaces are listed with a score that no path should take; the single space must stay usable
        usable = [i for i in normal if model.get_score(i) > UNUSED or self.names[i] == SPACE]
        if any(SPACE in self.names[i][1:] for i in usable):
            raise ValueError("a usable piece holds a space inside: words cannot be encoded apart")
        self.bytes_at = next(i for i in range(n) if self.names[i] == "<0x00>")
        self.longest = max(len(self.names[i]) for i in usable)
        keys = np.array([self._key(self.names[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array(usable, np.int32)[order]
        scores = np.array([model.get_score(i) for i in usable], np.float64)
        least = scores[scores > UNUSED].min()
        self.scores = np.maximum(scores, least)[order]
        assert (self.keys[1:] != self.keys[:-1]).all()
        self.unknown = float(least) - UNKNOWN_PENALTY
        self.text = [x.replace(SPACE, " ").encode() for x in self.names]
        for b in range(256):
            self.text[self.bytes_at + b] = bytes([b])
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _key(piece: str) -> int:
        return int(Pieces._keys(Pieces._prefix(np.array([[ord(c) for c in piece]], np.uint32)), 0, len(piece))[0])

    @staticmethod
    def _prefix(points: np.ndarray) -> np.ndarray:
        down = powers(points.shape[1])[1]
        out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * down[: points.shape[1]], axis=1, out=out[:, 1:])
        return out

    @staticmethod
    def _keys(prefix: np.ndarray, start: int, end: int) -> np.ndarray:
        return mix((prefix[:, end] - prefix[:, start]) * powers(end)[0][start] + np.uint64(end - start))

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian 16 bits) of words of one length."""
        n, length = len(words), len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(n, length)
        prefix = self._prefix(points)
        best = np.zeros((length + 1, n))
        back = np.zeros((length + 1, n), np.int32)
        piece = np.full((length + 1, n), -1, np.int32)
        for end in range(1, length + 1):
            score = best[end - 1] + self.unknown
            back[end] = end - 1
            for start in range(end - 1, max(end - self.longest, 0) - 1, -1):
                key = self._keys(prefix, start, end)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = best[start] + self.scores[at]
                better = (self.keys[at] == key) & (found >= score)
                score = np.where(better, found, score)
                back[end][better] = start
                piece[end][better] = self.ids[at[better]]
            best[end] = score
        steps = []
        pos, rows = np.full(n, length), np.arange(n)
        while pos.any():
            alive = pos > 0
            steps.append(np.where(alive, piece[pos, rows], -2))
            last = pos
            pos = np.where(alive, back[pos, rows], 0)
            steps[-1] = np.where(alive & (steps[-1] == -1), -3 - (last - 1), steps[-1])  # which character
        grid = np.array(steps[::-1]).T
        sizes = (grid != -2).sum(axis=1)
        if (grid > -3).all():
            flat = grid[grid != -2].astype("<u2").tobytes()
            ends = np.cumsum(sizes) * 2
            return [flat[a:b] for a, b in zip((ends - sizes * 2).tolist(), ends.tolist())]
        out = []
        for word, row in zip(words, grid.tolist()):
            ids: list[int] = []
            for i in row:
                if i >= 0:
                    ids.append(i)
                elif i <= -3:
                    ids += [self.bytes_at + b for b in word[-3 - i].encode()]
            out.append(np.array(ids, "<u2").tobytes())
        return out

    def long(self, word: str) -> bytes:
        """Ids of one long word: the same segmentation as by :meth:`viterbi`, in time linear in its length."""
        n = len(word)
        points = np.frombuffer(word.encode("utf-32-le"), "<u4").reshape(1, n)
        prefix, up = self._prefix(points)[0], powers(n)[0]
        best, back, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for a in range(0, n, CHUNK):
            b = min(a + CHUNK, n)
            found: list[list[tuple[int, float, int]]] = [[] for _ in range(b - a)]
            for size in range(min(self.longest, n - a), 0, -1):  # longer pieces first: they win ties
                starts = np.arange(a, min(b, n - size + 1))
                key = mix((prefix[starts + size] - prefix[starts]) * up[starts] + np.uint64(size))
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == key)
                for i, score, which in zip(hit.tolist(), self.scores[at[hit]].tolist(), self.ids[at[hit]].tolist()):
                    found[i].append((size, score, which))
            for i, pieces in enumerate(found, a):
                base = best[i]
                for size, score, which in pieces:
                    if base + score > best[i + size]:
                        best[i + size], back[i + size], piece[i + size] = base + score, i, which
                if base + self.unknown > best[i + 1]:
                    best[i + 1], back[i + 1], piece[i + 1] = base + self.unknown, i, -1
        ids: list[int] = []
        end = n
        while end:
            start = back[end]
            ids += [piece[end]] if piece[end] >= 0 else [self.bytes_at + x for x in reversed(word[start].encode())]
            end = start
        return np.array(ids[::-1], "<u2").tobytes()

    def _learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) > LONG:
                self.words[w] = self.long(SPACE + w)
            else:
                by_length.setdefault(len(w) + 1, []).append(w)
        for length, some in by_length.items():
            step = max(BATCH_CELLS // length, 1)
            for i in range(0, len(some), step):
                part = some[i : i + step]
                self.words.update(zip(part, self.viterbi([SPACE + w for w in part])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit integers. A text gets a space in front, so it is a row
        of words that each follow one space; an empty text has no ids."""
        out: list[bytes] = []
        for i in range(0, len(texts), 500):
            split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts[i : i + 500]]
            seen = set().union(*split)
            missing = seen.difference(self.words)
            if len(self.words) + len(missing) > WORDS_KEPT:
                self.words.clear()
                missing = seen
            self._learn(missing)
            get = self.words.__getitem__
            out += [b"".join(map(get, words)) for words in split]
            for w in (w for w in missing if len(w) > LONG):
                del self.words[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace") if raw else ""


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """One vocabulary for all tasks of a Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` for each row. Null and empty texts have no ids; the space sign itself
    counts as a space. Null or repeated doc_ids stay; empty tables give no rows; other columns are ignored."""
    model = model or vocabulary_path(MODEL)

    def run(batches):
        pieces = loaded(model)
        for batch in batches:
            for part in _slices(batch):
                raw = pieces.encode([t or "" for t in part.column("text").to_pylist()])
                flat = pa.array(np.frombuffer(b"".join(raw), "<u2").astype(np.int32))
                sizes = np.array([len(x) // 2 for x in raw], np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "n_tokens", "ids"])

    return _plain(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decoded(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids give an empty text."""
    model = model or vocabulary_path(MODEL)

    def run(batches):
        pieces = loaded(model)
        for batch in batches:
            texts = [pieces.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Encode and decode in one scan: ``(doc_id, n_tokens, ids_crc32, exact)``, the checksum being that of
    the ids as 16-bit little-endian integers and ``exact`` whether decoding gives the text again (it does not
    where the text holds the space sign itself). Null texts count as empty. Null or repeated doc_ids stay;
    empty tables give no rows; other columns are ignored."""
    model = model or vocabulary_path(MODEL)

    def run(batches):
        pieces = loaded(model)
        for batch in batches:
            for part in _slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                raw = pieces.encode(texts)
                exact = [pieces.decode(np.frombuffer(x, "<u2")) == t for x, t in zip(raw, texts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 2 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(exact, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "exact"])

    return _plain(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, exact boolean")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _slices(batch: pa.RecordBatch, rows: int = 500):
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def op7_sentencepiece(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))
