"""Operator 3: fuzzy line dedup.

Lines are compared as sets of character shingles: the 5 characters at every position; a line of fewer is one
shingle. Shingle hashes fall in 8 bins; the 4 least hashes of a bin, under as many masks, are a band of the line's
MinHash signature. Lines that share a band (0.985 of the pairs at a similarity of 0.8, 0.9998 at 0.9) are candidates,
unless under 14 of the 32 values agree. :mod:`.line_links` verifies them by their exact Jaccard similarity, in buckets of
any size. Distributed union-find joins linked lines, and the first line of each component stays.

All of it is DataFrame functions. :func:`line_sets` and :func:`line_bands` are numpy forms of the sets and of a signature
for callers that hold lines in memory; no query runs them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, release, stage, table
from .components import components
from .line_links import Rule, linked

SHINGLE = 5
BANDS, ROWS = 8, 4
#: Of the BANDS * ROWS signature values so many must agree. Half the bits of two different values differ, so rows that do
#: not pass for more than DIFFER of all 512 bits are told by those.
AGREE, DIFFER = 14, 190
THRESHOLD = 0.8
#: A line with more than this share of all lines has its rows dealt to SALTS tasks; there are 1,000 such lines at most.
HOT_SHARE, SALTS = 0.001, 64
#: Characters of lines that a task looks at together (longer lines alone).
TOGETHER = 1 << 19
#: What no text holds: pads lines of fewer characters than a shingle.
PAD = 0x110000
#: Masks under which a band's values are the least hashes of its bin.
MASKS = [int(x) for x in mix(np.arange(101, 101 + ROWS, dtype=np.uint64)).view(np.int64)]
#: Where a long holds each of four values.
LANES = [0xFFFF, 0xFFFF << 16, 0xFFFF << 32, -1 << 48]
#: Odd factors and offsets, one for each row of a signature.
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
OFFSETS = mix(FACTORS)


def line_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each line, repeats included, line after line, and where lines begin."""
    lines = column.to_pylist()
    tail = "\0" * SHINGLE
    points = np.frombuffer("".join([x + tail for x in lines]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(lengths + SHINGLE)
    for i in range(1, SHINGLE + 1):
        points[ends - i] = PAD
    a, b = np.uint64(21), np.uint64(42)
    n = max(len(points) - SHINGLE + 1, 0)
    low = points[:n] | points[1 : n + 1] << a | points[2 : n + 2] << b
    hashes = mix(low ^ mix(points[3 : n + 3] | points[4 : n + 4] << a))
    windows = np.maximum(lengths - SHINGLE + 1, 1)
    starts = np.concatenate(([0], np.cumsum(windows)))
    first = ends - lengths - SHINGLE
    return hashes[np.arange(starts[-1]) + np.repeat(first - starts[:-1], windows)], starts


def line_bands(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BANDS keys of each line and 16 bits of each signature value, as rows of arrays, and the number of shingles."""
    hashes, starts = line_sets(column)
    values = np.empty((len(column), BANDS * ROWS), np.uint16)
    keys = np.empty((len(column), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(column), band, np.uint64)
        for r in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat(hashes * FACTORS[r] + OFFSETS[r], starts[:-1])
            values[:, r] = (mix(least) >> np.uint64(48)).astype(np.uint16)
            key = mix(key ^ least)
        keys[:, band] = key
    return keys.view(np.int64), values, np.diff(starts)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """Every line with a word: ``(doc_id, th, pos, a, b)``, ``a`` and ``b`` being 128 bits of the line's hash."""
    word = (F.ascii("line") > 32) | F.col("line").rlike(r"\S")
    lines = _keyed(docs).select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(word)
    return lines.select("doc_id", "th", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), *more)


def distinct_lines(docs: DataFrame) -> DataFrame:
    """``(id, a, b, first, n, line)``: every line once, with a number of its own, its first place and its count."""
    each = _lines(docs, "line").groupBy("a", "b").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.count("*").alias("n"), F.first("line").alias("line"))
    return stage(each.select(F.monotonically_increasing_id().alias("id"), "a", "b", "first", "n", "line"), "lines", compression="zstd")


def _shingle(points: Column, i: Column) -> Column:
    """Hash of the shingle at a place of a line in four bytes a character."""
    return F.xxhash64(F.substring(points, i * 4 + 1, 4 * SHINGLE))


def _places(points: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.octet_length(points) / 4 - SHINGLE, F.lit(0)).cast("int"))


def shingles(line: Column) -> Column:
    """The distinct shingle hashes of a line."""
    # an array of one: the line is encoded once, not for each place
    bound = F.transform(F.array(F.encode(line, "UTF-32")), lambda p: F.transform(_places(p), lambda i: _shingle(p, i)))
    return F.array_distinct(bound[0])


def signatures(lines: DataFrame) -> DataFrame:
    """``(id, bands, values, size)`` of ``lines(id, line)``: the keys of the bands (null for an empty bin), for each band
    16 bits of its values in a long (0 for an empty bin), and the number of shingles."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt by id once: both aggregations below then run where the shingles are made
    points = lines.repartition(parts, "id").select("id", F.encode("line", "UTF-32").alias("points"))
    found = points.select("id", "points", F.explode(_places(F.col("points"))).alias("i")).select("id", _shingle(F.col("points"), F.col("i")).alias("h"))
    found = found.select("id", "h", F.col("h").bitwiseAND(F.lit(BANDS - 1).cast("long")).cast("int").alias("bin"))
    least = found.groupBy("id", "bin").agg(F.count("*").alias("n"), *[F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{r}") for r, m in enumerate(MASKS)])
    values = F.lit(0).cast("long")
    for r in range(ROWS):
        values = values.bitwiseOR(F.shiftleft(F.shiftrightunsigned(f"m{r}", 48), 16 * r))
    least = least.select("id", "bin", "n", F.xxhash64("bin", *[f"m{r}" for r in range(ROWS)]).alias("key"), values.alias("values"))
    of = lambda c: [F.max(F.when(F.col("bin") == b, F.col(c))).alias(f"{c}{b}") for b in range(BANDS)]
    made = least.groupBy("id").agg(F.sum("n").cast("int").alias("size"), *of("key"), *of("values"))
    return stage(made.select("id", F.array(*[f"key{b}" for b in range(BANDS)]).alias("bands"), F.array(*[F.coalesce(f"values{b}", F.lit(0).cast("long")) for b in range(BANDS)]).alias("values"), "size"), "signatures")


def _agree(x: list[Column], y: list[Column]) -> Column:
    """Whether enough signature values of two rows agree. Bins that are empty on both sides agree."""
    # columns and plain operators, so that joins compile it; values are counted only where bits allow it
    differ = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(x, y)]
    agree = [F.when(a.bitwiseXOR(b).bitwiseAND(F.lit(m)) == 0, 1).otherwise(0) for a, b in zip(x, y) for m in LANES]
    return (sum(differ[1:], differ[0]) <= DIFFER) & (sum(agree[1:], agree[0]) >= AGREE)


def removed(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, th, gone)``: the numbers of the lines to remove. Of each component of equal or similar
    lines the one that stays comes first by doc_id, text hash and line number (null ids first). Null texts and lines
    without a word have no rows; rows that repeat doc_id and text count as one document; an empty table gives no rows;
    columns beside doc_id and text are ignored."""
    lines = distinct_lines(docs)
    signed = signatures(lines)
    texts = lines.select("id", F.col("line").alias("x"))
    found = components(linked(signed, lambda ids: texts.join(ids.hint("shuffle_hash"), "id", "left_semi"), Rule(shingles, _agree, BANDS, threshold)))
    release(signed)
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    # lines that stand once and are like no other are through
    each = lines.select("id", "a", "b", "first", "n").join(found.hint("shuffle_hash"), F.col("id") == F.col("node"), "left").filter("n > 1 or component is not null")
    each = stage(each.select("a", "b", "first", "n", F.coalesce("component", "id").alias("c")), "named")
    total = lines.agg(F.sum("n")).first()[0] or 0
    keeper = each.groupBy("c").agg(F.min("first").alias("keep"), F.sum("n").alias("all")).filter("all > 1").select("c", "keep")
    hot = F.col("n") > total * HOT_SHARE
    repeated = each.join(keeper.hint("shuffle_merge"), "c").select("a", "b", "keep", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    often = F.broadcast(each.filter(hot).select("a", "b", F.lit(SALTS).alias("salts")))  # 1 / HOT_SHARE rows at most
    place = F.struct("doc_id", "th", "pos")
    spread = _lines(docs).join(often, ["a", "b"], "left").withColumn("salt", F.pmod(F.xxhash64(place), F.coalesce("salts", F.lit(1))).cast("int"))
    gone = spread.join(repeated.hint("shuffle_hash"), ["a", "b", "salt"]).filter(~place.eqNullSafe(F.col("keep")))
    return stage(gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "gone")


def remove_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All rows of ``docs`` with all their columns; ``text`` lacks the lines that repeat one elsewhere.

    Lines without a word stay and never count. Null texts stay null. Rows that repeat doc_id and text count
    as one document and get the same text. Null ids sort first. Empty tables give no rows. Lines are told
    apart by 128-bit hashes. Columns beside doc_id and text are carried as they are.
    """
    gone = removed(docs, threshold).select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), F.col("gone").alias("_gone"))
    joined = docs.join(gone.hint("shuffle_merge"), docs.doc_id.cast("long").eqNullSafe(gone._d) & (F.xxhash64(docs.text.cast("string")) == gone._h), "left")
    lines = F.split(docs.text, "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone["_gone"], i)), "\n")
    text = F.when(gone["_gone"].isNull(), docs.text).otherwise(kept).alias("text")
    return joined.select(*[text if c == "text" else docs[c] for c in docs.columns])


def op3_line_dedup(spark, sf_dir):
    """Lines, removed lines and a digest of what stays, of every document row; null texts count as empty.
    Repeated and null ids, empty tables and extra columns: see :func:`remove_lines`."""
    docs = table(spark, sf_dir, "documents")
    gone = removed(docs).select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), "gone")
    joined = _keyed(docs).join(gone.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    none = F.array().cast("array<int>")
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n"))
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.coalesce("gone", none)).cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))
