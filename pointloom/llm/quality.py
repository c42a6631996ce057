"""Operator 9: quality rules as a short-circuit cascade.

A rule computes what it needs of a text (words, lines, repeated windows …) when it runs; rules share what was
computed before. Each task estimates cost and selectivity of the rules, their measures included, on a sample
of its own rows, and orders them by rejections per second; a rule then runs only over the documents that
passed those before it. The verdict does not depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, column_bytes, prefix, run_hash, table

#: Rows of a task's sample, spread over the first rows it gets.
SAMPLE_ROWS, SAMPLE_OF = 40, 2000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Fixed values of the further rules.
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUPLICATE_LINES = 0.5
MEAN_WORD_CHARS = (2.0, 20.0)
MIN_WORDS_WITH_LETTER = 0.5
MAX_SHOUTED = 0.9

_hashes = WordHashes()


class Text:
    """One text and its measures, each computed once and only if asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def solid(self) -> bytes:
        return b"".join(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words."""
        return len(self.solid) if self.solid.isascii() else int(np.count_nonzero(np.frombuffer(self.solid, np.uint8) & 0xC0 != 0x80))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def plain(self) -> str:
        return self.raw.decode("utf-8", "replace")

    def measures(self) -> tuple[int, int, int, int, int]:
        return self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words


def repeated_words(words: list[bytes], w: int = REPEAT_WINDOW) -> int:
    n = len(words)
    if n <= w:
        return 0
    p = prefix(_hashes.array(words))
    starts = np.arange(n - w + 1)
    h = run_hash(p, starts, starts + w)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(h), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[: len(h)] += hit
    edge[w : w + len(h)] -= hit
    return int(np.count_nonzero(np.cumsum(edge[:n])))


def _few_words(t: Text) -> bool:
    # that many words take twice as many bytes, less one: short texts need no split
    return len(t.raw) < 2 * MIN_WORDS - 1 or t.n_words < MIN_WORDS


def _repeats(t: Text) -> bool:
    return 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words


def _symbols(t: Text) -> bool:
    # a word is a byte at least
    return t.n_symbols > 0 and t.n_symbols > MAX_SYMBOLS_PER_WORD * t.n_words


def _duplicate_lines(t: Text) -> bool:
    return t.n_dup_lines > MAX_DUPLICATE_LINES * len(t.lines)


def _word_length(t: Text) -> bool:
    return not MEAN_WORD_CHARS[0] * t.n_words <= t.word_chars <= MEAN_WORD_CHARS[1] * t.n_words


def _letters(t: Text) -> bool:
    words = t.plain.split()
    return sum(1 for w in words if w.isalpha() or any(map(str.isalpha, w))) < MIN_WORDS_WITH_LETTER * len(words)


def _shouted(t: Text) -> bool:
    if t.raw.isascii():
        upper = len(t.raw) - len(t.raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        lower = len(t.raw) - len(t.raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    else:
        upper, lower = sum(map(str.isupper, t.plain)), sum(map(str.islower, t.plain))
    return upper > MAX_SHOUTED * (upper + lower)


RULES: dict[str, Callable[[Text], bool]] = {"few_words": _few_words, "repeats": _repeats, "symbols": _symbols, "duplicate_lines": _duplicate_lines, "word_length": _word_length, "letters": _letters, "shouted": _shouted}


def plan(texts: list[bytes]) -> list[str]:
    """Rule names by rejections per second on a sample; each rule pays for its measures. An empty sample keeps
    the listed order."""
    worth = {}
    for name, rule in RULES.items():
        fresh = list(map(Text, texts))
        began = time.perf_counter()
        rejected = sum(map(rule, fresh))
        worth[name] = (rejected + 0.5) / (time.perf_counter() - began + 1e-6)
    return sorted(RULES, key=lambda name: -worth[name]) if texts else list(RULES)


def _sampled(texts: list[bytes]) -> list[bytes]:
    return texts[:SAMPLE_OF][:: max(min(len(texts), SAMPLE_OF) // SAMPLE_ROWS, 1)][:SAMPLE_ROWS]


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def assess(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Measures and verdict of every row. Null and empty texts have no words and fail. Rows with a null or
    repeated doc_id are judged like others; an empty table gives no rows; other columns are ignored. Here all
    base measures are reported, so only the further rules are spared."""

    def run(batches):
        names = order
        for batch in batches:
            raw = column_bytes(batch.column("text"))
            names = names or plan(_sampled(raw))
            texts = list(map(Text, raw))
            failed = [_few_words(t) or _repeats(t) for t in texts]
            kept = [not bad and not any(RULES[name](t) for name in names) for t, bad in zip(texts, failed)]
            m = [t.measures() for t in texts]
            columns = [pa.array(c, pa.int64()) for c in (zip(*m) if m else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], [x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def keep_good(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, in one scan. The text alone decides: null and
    empty ones go, repeated rows and rows without an id are judged like others, an empty table stays empty."""

    def run(batches):
        names = order
        for batch in batches:
            raw = column_bytes(batch.column("text"))
            names = names or plan(_sampled(raw))
            rules = [RULES[name] for name in names]
            alive = [i for i, t in enumerate(map(Text, raw)) if not any(rule(t) for rule in rules)]
            yield batch.take(pa.array(alive, pa.int64()))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_rules(spark, sf_dir):
    return assess(table(spark, sf_dir, "documents"))
