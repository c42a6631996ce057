"""Operator 1: SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in at most two bits
differ in at most one bit in one of the segments, so they share one of its 32 one-wildcard variants. The
index holds 64 variant rows for each distinct fingerprint. Keys with two members are verified as they stand.
Keys with more (near copies, boilerplate) are never paired off: their members are indexed once more by the
65 points at distance one or less, where all that share a point are within two bits of each other, so a
link of each member to the least one of its point loses no connection. Rows stay linear in the fingerprints
however large a group of copies is.

The pipeline's stage, :func:`keep_one`, takes these fingerprints and links. Two bits are met by almost identical
texts only, so links of MinHash bands over five-word shingles, verified by exact Jaccard similarity, are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import array_sets, linked
from .common import column_bytes, stage, table
from .components import components

SEED = 42
CHUNK = 1 << 16
PART_ROWS = 20_000
#: The pipeline's stage, apart from the operator's contract: shingle words, similarity, bands of MinHash rows.
NEAR_WORDS, NEAR_THRESHOLD = 5, 0.8
NEAR_BANDS, NEAR_ROWS = 8, 3
NEAR_MASKS = np.array([xxhash.xxh64_intdigest(str(i), 9) for i in range(NEAR_BANDS * NEAR_ROWS)], np.uint64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """Signed 64-bit SimHash of one text: a bit is set if it is in over half the shingle hashes."""
    found = text.lower().split()
    n = len(found) - words + 1
    if not found:
        return 0
    body, digest = b" ".join(found), xxhash.xxh64_digest
    if n < 2:
        return int.from_bytes(digest(body, SEED), "big", signed=True)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[words - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        raw = b"".join([digest(body[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row; null and wordless texts have fingerprint zero."""

    def run(batches):
        for batch in batches:
            values = [fingerprint(t, words) for t in column_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """One-wildcard variants of both 32-bit segments: ``(key, fp)``, 64 rows for each fingerprint."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    segment = F.when(F.col("v") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp")).bitwiseAND(mask)
    hole = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("v") % 32))
    key = F.shiftleft(F.col("v").cast("long"), 32).bitwiseOR(segment.bitwiseAND(hole))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select(key.alias("key"), "fp")


def _points(fps: DataFrame) -> DataFrame:
    """The fingerprint itself and its 64 neighbours at one bit: ``(point, fp)``."""
    flip = F.when(F.col("v") < 64, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("v"))).otherwise(F.lit(0).cast("long"))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("v")).select(F.col("fp").bitwiseXOR(flip).alias("point"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """Verified links ``(u, v)`` that connect all distinct fingerprints ``fps(fp)`` at two bits or fewer."""
    near: Column = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2
    # few bytes become 64 rows each: not to be left in the few partitions that bytes alone would make
    fps = stage(fps, "fps")
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), fps.count() // PART_ROWS)
    fps = fps.repartition(parts, "fp")
    index = _variants(fps)
    keys = stage(index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("v"), F.max("fp").alias("u")).filter("n > 1"), "keys")
    pairs = keys.filter("n = 2").select("u", "v").filter(near)
    # the crowded keys grow with the corpus: never broadcast
    crowded = keys.filter("n > 2").select("key").hint("merge")
    dense = stage(index.join(crowded, "key", "left_semi").select("fp").distinct(), "dense")
    points = _points(dense)
    least = points.groupBy("point").agg(F.count("*").alias("n"), F.min("fp").alias("v")).filter("n > 1").select("point", "v")
    stars = points.join(least.hint("shuffle_merge"), "point").select(F.col("fp").alias("u"), "v").filter("u <> v").filter(near)
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """Every row of ``docs`` as ``(doc_id, fingerprint, component_id)``: the 16-digit fingerprint and the
    smallest doc_id reachable over links of two differing bits or fewer.

    Rows that repeat a doc_id stay as they are. A null doc_id is kept, shares its fingerprint's component,
    and never names one; a component of such rows alone has a null id. Texts of fewer words than a shingle
    are one shingle; null and wordless texts have fingerprint zero and are linked like others. An empty
    table gives an empty result. Other columns are ignored.
    """
    rows = stage(fingerprints(docs, words), "fp")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(fps.select("fp")))
    # tables that grow with the corpus are merged, never broadcast
    named = fps.join(found.hint("shuffle_merge"), fps.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    named = stage(named, "named")
    names = named.groupBy("c").agg(F.min("least").alias("component_id"))
    of_fp = stage(named.join(names.hint("shuffle_merge"), "c").select("fp", "component_id"), "ids")
    return rows.join(of_fp.hint("shuffle_merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes, words: int = NEAR_WORDS) -> np.ndarray:
    """Sorted distinct signed 64-bit hashes of a text's word shingles; a shorter text is one shingle."""
    found = text.lower().split()
    grams = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    return np.unique(np.frombuffer(b"".join(map(_digest, grams)), ">i8").astype(np.int64))


def _digest(gram: bytes) -> bytes:
    return xxhash.xxh64_digest(gram, SEED)


def _bands(s: np.ndarray) -> list[int]:
    """One key for each band of the MinHash signature of a set; an empty set has none."""
    if not len(s):
        return []
    least = np.full(len(NEAR_MASKS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), CHUNK):
        np.minimum(least, (s[i : i + CHUNK].view(np.uint64)[None, :] ^ NEAR_MASKS[:, None]).min(axis=1), out=least)
    return [int.from_bytes(xxhash.xxh64_digest(r.tobytes(), b), "big", signed=True) for b, r in enumerate(least.reshape(NEAR_BANDS, NEAR_ROWS))]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _shingled(keyed: DataFrame, full: bool) -> DataFrame:
    """``(doc_id, th, a, size, x)`` of every row, ``a`` being the hash of its shingle set, ``size`` the set's size
    and ``x`` the set itself (``full``) or its bands, beside the SimHash ``fp`` of the operator."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in column_bytes(batch.column("text"))]
            names = pa.array([int.from_bytes(xxhash.xxh64_digest(s.tobytes(), SEED), "big", signed=True) for s in sets], pa.int64())
            lists = pa.array(sets if full else map(_bands, sets), pa.list_(pa.int64()))
            columns = [batch.column("doc_id"), batch.column("th"), names, pa.array(map(len, sets), pa.int32()), lists]
            if not full:
                columns.append(pa.array([fingerprint(t) for t in column_bytes(batch.column("text"))], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "a", "size", "x", "fp"][: len(columns)])

    return keyed.mapInArrow(run, "doc_id long, th long, a long, size int, x array<long>" + ("" if full else ", fp long"))


def near_links(keyed: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Links ``(u, v)`` between shingle sets that share a band and whose exact Jaccard similarity reaches
    ``threshold``. Equal sets are one node, so exact copies crowd no bucket."""
    nodes = stage(rows.groupBy(F.col("a").alias("id")).agg(F.first("x").alias("bands"), F.first("size").alias("size"), F.min(F.struct("doc_id", "th")).alias("one")), "near")

    def fetch(ids: DataFrame) -> DataFrame:
        one = nodes.join(ids.hint("shuffle_merge"), "id", "left_semi").select(F.col("one.doc_id").alias("_d"), F.col("one.th").alias("_h"))
        texts = keyed.join(one.hint("shuffle_merge"), keyed.doc_id.eqNullSafe(one._d) & (keyed.th == one._h), "left_semi")
        return _shingled(texts, True).groupBy(F.col("a").alias("id")).agg(F.first("x").alias("x"))

    return linked(nodes.select("id", "bands", "size"), fetch, array_sets, threshold)


def simhash_links(rows: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between shingle sets ``rows(a, fp)`` whose fingerprints reach each other over the operator's
    links: of each component, every set with its least one."""
    each = stage(rows.select("a", "fp").distinct(), "fps")
    found = components(links(each.select("fp").distinct()))
    named = each.join(found.hint("shuffle_merge"), each.fp == found.node, "left").select("a", F.coalesce("component", "fp").alias("c"))
    named = stage(named, "named")
    least = named.groupBy("c").agg(F.min("a").alias("v"))
    return named.join(least.hint("shuffle_merge"), "c").select(F.col("a").alias("u"), "v").filter("u <> v")


def keep_one(docs: DataFrame, threshold: float = NEAR_THRESHOLD) -> DataFrame:
    """The documents of ``docs``, all columns kept, without those that are near copies of another: of each
    component of texts linked by SimHash fingerprints of two differing bits or fewer, or by a Jaccard similarity of
    ``threshold`` or more between their sets of NEAR_WORDS-word shingles, the row that comes first by doc_id (null ids
    last) and text hash stays.

    Rows are told apart by doc_id and text hash, so a repeated or null id costs no other row its place; rows
    equal in both stay or go together. Null and wordless texts are copies of each other.
    """
    keyed = _keyed(docs)
    rows = stage(_shingled(keyed, False), "rows")
    found = components(simhash_links(rows).unionByName(near_links(keyed, rows, threshold).select("u", "v")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    each = rows.groupBy("a").agg(F.min(place).alias("first"))
    each = stage(each.join(found.hint("shuffle_merge"), each.a == found.node, "left").select("a", "first", F.coalesce("component", "a").alias("c")), "named")
    keep = each.groupBy("c").agg(F.min("first").alias("keep"))
    lost = rows.join(each.join(keep.hint("shuffle_merge"), "c").select("a", "keep").hint("shuffle_merge"), "a").filter(~place.eqNullSafe(F.col("keep")))
    lost = lost.select(F.col("doc_id").alias("_d"), F.col("th").alias("_h")).distinct()
    return docs.join(lost, docs.doc_id.cast("long").eqNullSafe(lost._d) & (F.xxhash64(docs.text.cast("string")) == lost._h), "left_anti")


def op1_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
