"""Operator 10: token ids as directly addressable codes.

Documents are range-partitioned by doc_id, encoded with the public word vocabulary and written, in id order,
as a Parquet table whose rows are chunks of whole documents. A chunk holds its ids as directly addressable
codes: level k keeps 8 bits of every id that reaches it, a continuation bitmap says which ids go on, and a
rank directory (set bits before every 512) finds an id's place in the next level, so any token is read from
two or three bytes without decoding what stands before it (:func:`tokens_at`). The files are not compressed
and chunks are small, so that nothing has to be unpacked on the way to those bytes.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stage, table

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CHUNK_TOKENS = 1 << 15
#: Documents of a range partition; more partitions than Spark's setting where a table has more.
PART_ROWS = 40_000
RANK_BITS = 512


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """The tokenizers library behind a bounded memory of words.

    White space always ends a pre-token of this vocabulary, so a text's ids are those of its words. Words not
    met before go to the library many at a time, joined by spaces, and are told apart by the offsets of their
    ids. Texts with a special token's string, or with control characters that only Python takes for white
    space, go to the library whole, as do texts that its normal form (NFC, before lower-casing) changes, or
    whose lower case it would change. Words over ``longest`` characters are not remembered.
    """

    words_kept, words_a_call, longest = 800_000, 2000, 100
    #: One mark between a plain letter and white space is a pre-token of its own: a space may stand before it.
    tail = re.compile(r"([.,!?;:])(?<=[a-zß-öø-ɏ].)(?=\s|$)")
    #: Capitals whose lower case depends on their neighbours in Python, or has two characters.
    odd_case = ("Σ", "İ")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.whole = ("\x1c", "\x1d", "\x1e", "\x1f", *(t.content for t in self.library.get_added_tokens_decoder().values()))

    def ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _split(self, text: str) -> list[str] | None:
        if any(map(text.__contains__, self.whole)):
            return None
        low = text.lower()
        if not text.isascii():
            if any(map(text.__contains__, self.odd_case)):
                return text.split() if unicodedata.is_normalized("NFC", text) else None
            if not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
                return None
        return self.tail.sub(r" \1", low).split()

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), self.words_a_call):
            part = words[i : i + self.words_a_call]
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *map(len, part)])[:-1] + np.arange(len(part))
            firsts = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            bounds = (np.searchsorted(firsts, starts) * 4).tolist()
            raw = np.array(found.ids, "<u4").tobytes()
            self.words.update((w, raw[a:b]) for w, a, b in zip(part, bounds, [*bounds[1:], len(raw)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = []
        for i in range(0, len(texts), 500):
            split = list(map(self._split, texts[i : i + 500]))
            seen = set()
            for words in split:
                seen.update(words or ())
            missing = seen.difference(self.words)
            if len(self.words) + len(missing) > self.words_kept:
                self.words.clear()
                missing = seen
            self._learn(list(missing))
            get = self.words.__getitem__
            out += [self.ids(t) if w is None else b"".join(map(get, w)) for t, w in zip(texts[i : i + 500], split)]
            for w in (w for w in missing if len(w) > self.longest):
                del self.words[w]
        return out


_loaded: dict[str, WordEncoder] = {}


def loaded(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


# --- directly addressable codes ------------------------------------------------------------------


def dac_encode(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of 8 bits: chunk bytes, continuation bitmap (little-endian bits) and its rank directory."""
    levels, now = [], ids.astype("<u4")
    while True:
        more = now > 255
        bits = np.packbits(more, bitorder="little")
        steps = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), RANK_BITS // 8)) if len(bits) else np.zeros(0, int)
        ranks = np.concatenate(([0], np.cumsum(steps)))[:-1] if len(bits) else steps
        levels.append({"data": (now & 255).astype("u1").tobytes(), "more": bits.tobytes(), "ranks": ranks.astype("<u4").tobytes()})
        if not more.any():
            return levels
        now = now[more] >> 8


def dac_decode(levels: list[dict[str, bytes]]) -> np.ndarray:
    values = np.zeros(0, np.uint32)
    for level in reversed(levels):
        data = np.frombuffer(level["data"], "u1").astype("<u4")
        more = np.unpackbits(np.frombuffer(level["more"], "u1"), count=len(data), bitorder="little").astype(bool)
        data[more] |= values << 8
        values = data
    return values


def dac_access(levels: list[dict[str, bytes]], i: int) -> int:
    """The id at place ``i``: one byte, one bit and one rank a level."""
    value = 0
    for shift, level in zip(range(0, 32, 8), levels):
        value |= level["data"][i] << shift
        more = np.frombuffer(level["more"], "u1")
        if not more[i >> 3] >> (i & 7) & 1:
            break
        block = i // RANK_BITS
        part = more[block * RANK_BITS // 8 : i >> 3]
        inside = int(np.bitwise_count(part).sum()) + int(more[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        i = int(np.frombuffer(level["ranks"], "<u4")[block]) + inside
    return value


CHUNKS = "part int, chunk int, n_tokens long, doc_ids array<long>, lengths array<long>, levels array<struct<data:binary,more:binary,ranks:binary>>"


def write_tokens(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Encode whole texts, close each document with ``end_id`` and write the chunks in ascending doc_id
    order (null ids first; rows of one id by text). Returns the table read back. A null or empty text is
    its end id alone; an empty table makes an empty file set. Extra columns are ignored."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches):
        from pyspark import TaskContext

        part, chunk, held, ids, n = TaskContext.get().partitionId(), 0, [], [], 0
        coder = loaded(vocabulary)
        end = np.array([end_id], "<u4").tobytes()

        def close():
            lengths = [len(x) // 4 for x in ids]
            row = {"part": part, "chunk": chunk, "n_tokens": sum(lengths), "doc_ids": held, "lengths": lengths, "levels": dac_encode(np.frombuffer(b"".join(ids), "<u4"))}
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i in range(0, len(texts), 500):
                for key, raw in zip(keys[i : i + 500], coder.encode([t or "" for t in texts[i : i + 500]])):
                    held.append(key)
                    ids.append(raw + end)
                    n += len(raw) // 4 + 1
                    if n >= CHUNK_TOKENS:
                        yield close()
                        chunk, held, ids, n = chunk + 1, [], [], 0
        if held:
            yield close()

    ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("levels", pa.list_(pa.struct([("data", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])))])
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_h", F.xxhash64("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // PART_ROWS)
    ordered = rows.repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    chunks = ordered.mapInArrow(run, CHUNKS)
    if path is None:
        return stage(chunks, "tokens", compression="none")
    chunks.write.parquet(path, compression="none")
    return spark.read.schema(CHUNKS).parquet(path)


def read_tokens(chunks: DataFrame) -> DataFrame:
    """One row for each stored document: ``(doc_id, start, n_tokens, ids array<int>)``."""
    return _read(chunks, True)


def _read(chunks: DataFrame, with_ids: bool) -> DataFrame:
    last = "ids array<int>" if with_ids else "ids_crc32 long"

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values = dac_decode(row["levels"])
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                parts = [values[a:b] for a, b in zip(starts, ends)]
                found = pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())) if with_ids else pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64())
                n = len(lengths)
                arrays = [pa.repeat(pa.scalar(row["part"], pa.int32()), n), pa.repeat(pa.scalar(row["chunk"], pa.int32()), n), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(lengths), found]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "chunk", "doc_id", "at", "n_tokens", last.split()[0]])

    bases = _bases(chunks)
    rows = chunks.select("part", "chunk", "doc_ids", "lengths", "levels").mapInArrow(run, f"part int, chunk int, doc_id long, at long, n_tokens long, {last}")
    return rows.join(bases.drop("n_tokens"), ["part", "chunk"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", last.split()[0])


def _bases(chunks: DataFrame) -> DataFrame:
    """``(part, chunk, n_tokens, base)``: the tokens before each chunk."""
    sizes = chunks.select("part", "chunk", "n_tokens")
    of_parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each file: a few thousand numbers
    of_parts = of_parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(of_parts, "part").select("part", "chunk", "n_tokens", (F.col("base") + F.col("inner")).alias("base"))


def tokens_at(chunks: DataFrame, positions: DataFrame) -> DataFrame:
    """``(position, token)`` for each row of ``positions(position)``: the ids at places of the whole file set,
    each read from its own bytes of one chunk. Null places and places outside have no row; repeats stay. Places are
    gathered by chunk first (CHUNK_TOKENS different ones at most), so a chunk is read and moved once."""

    def run(batches):
        for batch in batches:
            for levels, wanted in zip(batch.column("levels"), batch.column("wanted").to_pylist()):
                levels = levels.as_py()
                columns = list(zip(*((w["position"], dac_access(levels, w["at"]), w["times"]) for w in wanted)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["position", "token", "times"])

    of = lambda c: F.floor(F.col(c) / CHUNK_TOKENS)
    # a chunk meets its places by ranges of CHUNK_TOKENS places
    ranges = _bases(chunks).withColumn("last", F.col("base") + F.col("n_tokens") - 1).withColumn("range", F.explode(F.sequence(of("base"), of("last"))))
    once = positions.groupBy(F.col("position").cast("long").alias("position")).agg(F.count("*").alias("times"))
    met = once.withColumn("range", of("position")).join(ranges, "range").filter("position between base and last")
    place = F.struct("position", (F.col("position") - F.col("base")).alias("at"), "times")
    wanted = met.groupBy("part", "chunk").agg(F.collect_list(place).alias("wanted"))
    found = wanted.join(chunks.select("part", "chunk", "levels"), ["part", "chunk"]).select("wanted", "levels").mapInArrow(run, "position long, token long, times long")
    return found.select("position", "token", F.explode(F.sequence(F.lit(1), F.col("times")))).select("position", "token")


def op10_token_binary_output(spark, sf_dir):
    """Written to the shared folder and read back: start, length and checksum of every document's ids."""
    shared_dir(spark)
    return _read(write_tokens(table(spark, sf_dir, "documents")), False)
