"""Operator 13: fill-in-middle transformation over seekable compressed texts.

A text is stored as independent zstandard frames of UNITS code points each, beside the cumulative counts at
which they begin. Any range of code points is read by decompressing the frames that it touches. A cut thus
opens one frame; frames between the cuts are taken over into the output as they are, and digests stream the
frames in order, one decompressed frame at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table

#: Code points of a frame, and the zstandard level.
UNITS, LEVEL = 8192, 3
#: Fixed values of the contract: sentinels, percent of texts that are cut, percent of those with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT, SUFFIX_FIRST = 90, 20
#: Bytes of frames after which a batch is handed on.
TOGETHER = 1 << 24

STORE = "doc_id long, n long, marked boolean, starts array<long>, frames array<binary>"
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, starts array<long>, frames array<binary>"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}


class Frames:
    """A text as compressed frames; ``starts[i]`` code points come before frame i, ``starts[-1]`` is the length."""

    def __init__(self, starts: list[int] | None = None, frames: list[bytes] | None = None):
        self.starts = [0] if starts is None else starts
        self.frames = [] if frames is None else frames

    def add(self, text: str) -> None:
        """Append a text, in frames of its own."""
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for i in range(0, len(text), UNITS):
            piece = text[i : i + UNITS]
            self.frames.append(pack(piece.encode()))
            self.starts.append(self.starts[-1] + len(piece))

    def extend(self, other: Frames, low: int, high: int) -> None:
        """Append code points [low, high) of ``other``; frames inside the range are not opened."""
        for i in other.touched(low, high):
            a, b = max(low - other.starts[i], 0), min(high, other.starts[i + 1]) - other.starts[i]
            if b - a == other.starts[i + 1] - other.starts[i]:
                self.frames.append(other.frames[i])
                self.starts.append(self.starts[-1] + b)
            else:
                self.add(other.open(i)[a:b])

    def touched(self, low: int, high: int) -> range:
        if low >= high:
            return range(0)
        return range(int(np.searchsorted(self.starts, low, "right")) - 1, int(np.searchsorted(self.starts, high, "left")))

    def open(self, i: int) -> str:
        return zstandard.ZstdDecompressor().decompress(self.frames[i]).decode()

    def read(self, low: int, high: int) -> Iterator[str]:
        """Code points [low, high), frame after frame."""
        for i in self.touched(low, high):
            yield self.open(i)[max(low - self.starts[i], 0) : min(high, self.starts[i + 1]) - self.starts[i]]

    def find(self, mark: str, low: int) -> int:
        """The first place of ``mark`` from ``low`` on, also where it crosses frames."""
        tail, at = "", low
        for piece in self.read(low, self.starts[-1]):
            seen = tail + piece
            if (k := seen.find(mark)) >= 0:
                return at - len(tail) + k
            at += len(piece)
            tail = seen[1 - len(mark) :]
        raise ValueError(f"no {mark} in this output")


def sha256(parts: Iterator[str]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part.encode())
    return digest.hexdigest()


def choose(doc_id: int | None, n: int, marked: bool) -> tuple[str, int, int]:
    """Form and the two cuts, from the digest of the id; an absent id counts as no digits."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == 0 or marked or h3 % 100 >= CUT:
        return "plain", a, b
    return "spm" if h4 % 100 < SUFFIX_FIRST else "psm", a, b


def arranged(text: Frames, form: str, a: int, b: int) -> Frames:
    """The output: sentinels and the three parts, in the order of ``form``."""
    if form == "plain":
        return text
    out, n = Frames(), text.starts[-1]
    prefix, suffix = (PREFIX, 0, a), (SUFFIX, b, n)
    for mark, low, high in (*((suffix, prefix) if form == "spm" else (prefix, suffix)), (MIDDLE, a, b)):
        out.add(mark)
        out.extend(text, low, high)
    return out


def restored(out: Frames, form: str) -> Iterator[str]:
    """The text again, from an output and its form alone."""
    if form == "plain":
        yield from out.read(0, out.starts[-1])
        return
    second, size = SUFFIX if form == "psm" else PREFIX, len(PREFIX)
    i = out.find(second, size)
    j = out.find(MIDDLE, i + size)
    first, other, middle = (size, i), (i + size, j), (j + size, out.starts[-1])
    for low, high in ((first, middle, other) if form == "psm" else (other, middle, first)):
        yield from out.read(low, high)


def _batches(rows: Iterator[tuple], schema: str, weight) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about TOGETHER in weight."""
    fields = [x.split() for x in schema.split(", ")]
    held, total = [], 0

    def batch():
        columns = zip(*held) if held else [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(list(c), TYPES[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])

    for row in rows:
        held.append(row)
        total += weight(row)
        if total >= TOGETHER:
            yield batch()
            held, total = [], 0
    yield batch()


def _frame_bytes(row: tuple) -> int:
    return 64 + sum(map(len, row[-1]))


def stored(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, marked, starts, frames)`` of every row: code points, whether the text holds a sentinel, and
    its frames with the counts at which they begin. Null and empty texts have no frame. Rows that repeat an id
    or lack one are stored like others; other columns are ignored; an empty table gives no rows."""

    def rows(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                f = Frames()
                f.add(text)
                yield doc_id, len(text), any(m in text for m in (PREFIX, SUFFIX, MIDDLE)), f.starts, f.frames

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(lambda batches: _batches(rows(batches), STORE, _frame_bytes), STORE)


def _read(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def transformed(store: DataFrame) -> DataFrame:
    """The outputs of :func:`stored` texts, again as frames, with form and sizes (null where plain)."""

    def rows(batches):
        for batch in batches:
            for r in _read(batch):
                form, a, b = choose(r["doc_id"], r["n"], r["marked"])
                out = arranged(Frames(r["starts"], r["frames"]), form, a, b)
                sizes = (None, None) if form == "plain" else (a, b - a)
                yield r["doc_id"], r["n"], form, *sizes, out.starts, out.frames

    return store.mapInArrow(lambda batches: _batches(rows(batches), OUTPUT, _frame_bytes), OUTPUT)


def texts(outputs: DataFrame) -> DataFrame:
    """``(doc_id, form, output)`` as plain text, for trainers."""

    def rows(batches):
        for batch in batches:
            for r in _read(batch):
                yield r["doc_id"], r["form"], "".join(Frames(r["starts"], r["frames"]).read(0, r["starts"][-1]))

    schema = "doc_id long, form string, output string"
    return outputs.mapInArrow(lambda batches: _batches(rows(batches), schema, lambda r: len(r[2])), schema)


def digests(outputs: DataFrame) -> DataFrame:
    """Digests of every output and of the text restored from it, streamed frame after frame."""

    def rows(batches):
        for batch in batches:
            for r in _read(batch):
                out = Frames(r["starts"], r["frames"])
                yield r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], sha256(out.read(0, out.starts[-1])), sha256(restored(out, r["form"]))

    return outputs.mapInArrow(lambda batches: _batches(rows(batches), DIGESTS, lambda r: 256), DIGESTS)


def op13_fill_in_middle(spark, sf_dir):
    """The store of all texts is written once; outputs and digests come from it. Nulls, empty texts, repeated
    and absent ids, extra columns and empty tables: see :func:`stored`."""
    return digests(transformed(stage(stored(table(spark, sf_dir, "documents")), "frames")))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS p3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS p4 FROM d),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p3 >= 90 THEN 'plain' WHEN p4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x
"""
