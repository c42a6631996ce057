"""Operator 4: substring dedup of word windows by matching statistics over an FM-index per shard.

A shard's pieces (see windows.py) are indexed together: suffix array by prefix doubling, its BWT in a wavelet
tree (levelwise, with rank directories), LCP values and least document ranks over suffix intervals. Every
piece is then streamed from right to left through backward search; an interval that holds no earlier
document falls back to the nearest ancestor in the suffix tree that does. The length kept so is the matching statistic against
earlier documents; where it reaches 50 words, a window is reported.

Passages that stand in an earlier document with all their surroundings take the same way: a shard indexes the first
documents' passages, and the later documents' are streamed through that index in batches, without being indexed.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count, repeat

import numpy as np

from .common import WordHashes, table
from .windows import WINDOW, Unit, deduplicated

#: Segments of later documents that are streamed through a shard's index at a time.
STREAMED = 1 << 13
_hashes = WordHashes()
WORDS = Unit(k=16, source=lambda text: text.split(), hashes=_hashes.array, cut=lambda words, a, b: b" ".join(words[a:b]) + b" ")


class Bits:
    """A bit vector with a rank directory: set bits before every 64-bit word."""

    def __init__(self, bits: np.ndarray):
        raw = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(raw)] = raw
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletTree:
    """Rank of any symbol in a sequence, a bit vector for each bit of the symbols, highest first."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        now = symbols
        for bit in reversed(range(max(int(sigma - 1).bit_length(), 1))):
            ones = (now >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), int(len(now) - ones.sum())))
            now = np.concatenate((now[~ones], now[ones]))
        self.start = np.zeros(sigma + 1, np.int64)
        new = np.concatenate(([True], now[1:] != now[:-1]))
        self.start[now[new]] = np.flatnonzero(new)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol c before its place i."""
        at = i
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(c >> bit & 1, zeros + ones, at - ones)
        return at - self.start[c]


class SparseMin:
    """Least value of any range, from the least values of all ranges of two-power length."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        size = 1
        while 2 * size <= len(values):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-size], last[size:]))
            size *= 2
        width = max(len(t) for t in self.tables)
        self.flat = np.concatenate([np.pad(t, (0, width - len(t)), mode="edge") for t in self.tables])
        self.width = width

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over [a, b), which must not be empty."""
        level = np.frexp((b - a).astype(np.float64))[1].astype(np.int64) - 1
        row = level * self.width
        return np.minimum(self.flat[row + a], self.flat[row + b - (np.int64(1) << level)])


class FMIndex:
    """Index of pieces; symbol 0 closes each piece. ``ranks`` are the documents' ranks by id."""

    def __init__(self, text: np.ndarray, ranks: np.ndarray, sigma: int):
        n = self.n = len(text)
        levels = [np.unique(text, return_inverse=True)[1].astype(np.int32)]
        k = 1
        while True:
            rank = levels[-1].astype(np.int64)
            key = rank * (n + 1)
            key[: n - k] += rank[k:] + 1
            order = np.argsort(key, kind="stable")
            now = np.empty(n, np.int32)
            now[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
            levels.append(now)
            if now[order[-1]] == n - 1 or 2 * k >= n:
                break
            k *= 2
        self.sa = order
        self.last = text[order - 1].astype(np.int32)
        self.back = now[order - 1]  # where the suffix with one symbol more stands
        self.tree = WaveletTree(self.last, sigma)
        self.count = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.lcp = SparseMin(self._lcp(levels))
        self.first = SparseMin(ranks[order].astype(np.int32))

    def _lcp(self, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each suffix with the one before it, from the ranks of the doublings. The ends
        of the array get 0."""
        a, b = self.sa[1:].copy(), self.sa[:-1].copy()
        out = np.zeros(self.n - 1, np.int64)
        for j in reversed(range(len(levels) - 1)):
            padded = np.append(levels[j], -1)
            x, y = np.minimum(a + out, self.n), np.minimum(b + out, self.n)
            out += np.where((padded[x] == padded[y]) & (x < self.n) & (y < self.n), 1 << j, 0)
        return np.minimum(np.concatenate(([0], out, [0])), np.iinfo(np.int16).max).astype(np.int16)

    def extend(self, c, low, high):
        """Interval of the string that c and the interval's string make. An interval of one suffix has one extension,
        which is remembered; others are ranked in the wavelet tree."""
        single = high - low == 1
        one, more = np.flatnonzero(single), np.flatnonzero(~single)
        a, b = np.empty(len(c), np.int64), np.empty(len(c), np.int64)
        a[one] = self.back[low[one]]
        b[one] = a[one] + (self.last[low[one]] == c[one])
        wide, m = c[more], len(more)
        both = self.tree.rank(np.concatenate((wide, wide)), np.concatenate((low[more], high[more])))
        a[more], b[more] = self.count[wide] + both[:m], self.count[wide] + both[m:]
        return a, b

    def widen(self, low, high, depth):
        """Interval of the first ``depth`` symbols of an interval's string: the suffix-tree ancestor."""
        a, b = low.copy(), high.copy()
        width, flat = self.lcp.width, self.lcp.flat
        for j in reversed(range(len(self.lcp.tables))):
            size = 1 << j
            # a moves left while the values of (a - size, a] reach the depth
            ok = (a >= size) & (flat[j * width + np.maximum(a - size + 1, 0)] >= depth)
            a -= ok * size
            # b moves right while the values of [b, b + size) reach it
            ok = (b + size <= self.n) & (flat[j * width + np.minimum(b, width - 1)] >= depth)
            b += ok * size
        root = depth <= 0
        return np.where(root, 0, a), np.where(root, self.n, b)

    def feasible(self, low, high, own):
        """Whether an interval holds a document before ``own``."""
        ok = np.zeros(len(low), bool)
        one, more = np.flatnonzero(high - low == 1), np.flatnonzero(high - low > 1)
        ok[one] = self.first.tables[0][low[one]] < own[one]
        ok[more] = self.first.least(low[more], high[more]) < own[more]
        return ok

    def shorten(self, c, low, high, length, own):
        """For intervals that c cannot extend: the longest prefix of their strings that it can, extended.
        Depths are searched by halves, since an ancestor holds all that its descendants hold."""
        low, high = low.copy(), high.copy()
        least = np.zeros(len(c), np.int64)
        most = length - 1
        a, b = self.count[c], self.count[c + 1]
        fits = self.feasible(a, b, own)
        best_a, best_b = np.where(fits, a, 0), np.where(fits, b, self.n)
        most = np.where(fits, most, 0)
        while True:
            at = np.flatnonzero(least < most)
            if not len(at):
                return best_a, best_b, np.where(fits, least + 1, 0)
            mid = (least[at] + most[at] + 1) // 2
            wide_a, wide_b = self.widen(low[at], high[at], mid)
            a, b = self.extend(c[at], wide_a, wide_b)
            ok = self.feasible(a, b, own[at])
            good = at[ok]
            least[good] = mid[ok]
            best_a[good], best_b[good] = a[ok], b[ok]
            most[at[~ok]] = mid[~ok] - 1

    def statistics(self, text: np.ndarray, ends: np.ndarray, sizes: np.ndarray, own: np.ndarray, holds: np.ndarray, k: int, cap: int):
        """Yield (piece, place) wherever ``cap`` items or more that start there occur in an earlier document.
        All pieces advance together, from their last item to their first. Every window of a piece holds its
        minimizer, the ``k`` items from ``holds`` on: once a match that starts there or before no longer
        reaches the minimizer's end, no window further left can match and the piece is through."""
        m = len(ends)
        alive = np.ones(m, bool)
        low, high, length = np.zeros(m, np.int64), np.full(m, self.n, np.int64), np.zeros(m, np.int64)
        for step in range(int(sizes.max(initial=0))):
            todo = np.flatnonzero((sizes > step) & alive)
            if not len(todo):
                continue
            c = text[ends[todo] - 1 - step]
            a, b = self.extend(c, low[todo], high[todo])
            ok = self.feasible(a, b, own[todo])
            good, bad = todo[ok], todo[~ok]
            low[good], high[good] = a[ok], b[ok]
            length[good] += 1
            if len(bad):
                low[bad], high[bad], length[bad] = self.shorten(c[~ok], low[bad], high[bad], length[bad], own[bad])
            start = sizes[todo] - 1 - step
            alive[todo] = (start > holds[todo]) | (start + length[todo] >= holds[todo] + k)
            full = todo[length[todo] >= cap]
            if len(full):
                yield full, sizes[full] - 1 - step


def resolve(items: list[bytes], sizes: np.ndarray, ids: np.ndarray, holds: np.ndarray, window: int = WINDOW) -> tuple:
    """(piece, start, end) of the windows of each piece that also start in a piece of a smaller id, runs
    joined."""
    words = b"".join(items).split()
    codes: dict[bytes, int] = defaultdict(count(1).__next__)
    symbols = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    ranks = np.unique(ids, return_inverse=True)[1]
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    text = np.zeros(len(words) + n, np.int64)
    text[np.arange(len(words)) + owner] = symbols
    ends = np.cumsum(sizes) + np.arange(n)
    index = FMIndex(text, np.repeat(ranks, sizes + 1), len(codes) + 1)
    pieces, places = [], []
    for piece, place in index.statistics(text, ends, sizes.astype(np.int64), ranks, holds.astype(np.int64), WORDS.k, window):
        pieces.append(piece)
        places.append(place)
    return _joined(pieces, places, window)


def _joined(pieces: list[np.ndarray], places: list[np.ndarray], window: int) -> tuple:
    """(piece, start, end) of the runs of windows at consecutive places."""
    if not pieces:
        return (np.zeros(0, np.int64),) * 3
    piece, place = np.concatenate(pieces), np.concatenate(places)
    o = np.lexsort((place, piece))
    piece, place = piece[o], place[o]
    head = np.concatenate(([True], (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)))
    h = np.flatnonzero(head)
    return piece[h], place[h], place[np.append(h[1:] - 1, len(place) - 1)] + window


def stream(items: list[bytes], sizes: np.ndarray, ids: np.ndarray, asked: list[bytes], lengths: np.ndarray, owners: np.ndarray, window: int = WINDOW) -> tuple:
    """(segment, start, end) of the windows of each segment asked for that start in an indexed passage of a smaller id
    than its owner's, runs joined. Words that no passage holds match nothing."""
    words = b"".join(items).split()
    codes: dict[bytes, int] = defaultdict(count(1).__next__)
    symbols = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    n, foreign = len(sizes), len(codes) + 1
    ranks, mine = np.split(np.unique(np.concatenate((ids, owners)), return_inverse=True)[1], [n])
    owner = np.repeat(np.arange(n), sizes)
    text = np.zeros(len(words) + n, np.int64)
    text[np.arange(len(words)) + owner] = symbols
    index = FMIndex(text, np.repeat(ranks, sizes + 1), foreign + 1)
    pieces, places = [], []
    for a in range(0, len(asked), STREAMED):
        some = lengths[a : a + STREAMED].astype(np.int64)
        words = b"".join(asked[a : a + STREAMED]).split()
        pattern = np.fromiter(map(codes.get, words, repeat(foreign)), np.int64, len(words))
        for piece, place in index.statistics(pattern, np.cumsum(some), some, mine[a : a + STREAMED], np.zeros(len(some), np.int64), 0, window):
            pieces.append(piece + a)
            places.append(place)
    return _joined(pieces, places, window)


def _report(words: list[bytes], n: int, s: np.ndarray, e: np.ndarray) -> tuple:
    kept = words if not len(s) else [w for a, b in zip([0, *e.tolist()], [*s.tolist(), n]) for w in words[a:b]]
    return n, int((e - s).sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), [x for pair in zip(s.tolist(), e.tolist()) for x in pair]


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<long>"


def repeated_words(docs):
    """One row for each document row, ``spans`` being start and end of every removed word run in turn.

    Null texts have no words. Rows without an id count as later than all others and as one document; rows of
    one id never remove each other. Windows do not cross documents. Empty tables give no rows; other columns
    are ignored.
    """
    return deduplicated(docs, WORDS, resolve, RESULT, _report, shards_a_group=4, stream=stream)


def op4_substring_dedup(spark, sf_dir):
    return repeated_words(table(spark, sf_dir, "documents")).drop("spans")
