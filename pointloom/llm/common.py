"""Helpers the operators share: staged tables, word splitting and numpy hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ASCII letters for lower-casing without touching other scripts.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates alphanumeric words: every ASCII character but digits and lower-case letters.
ALNUM_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode where none is named (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-stage-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors,
    and lets Spark drop the shuffle files that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, **options)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*dfs: DataFrame) -> None:
    """Delete tables made by :func:`stage` that nothing reads any more."""
    for df in dfs:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def alnum_words(c: Column) -> Column:
    """Words of digits, a-z and non-ASCII characters after lower-casing A-Z; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(c, F.lit(""))), ALNUM_BREAK), "")


# --- numpy hashing -------------------------------------------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class WordHashes(dict):
    """XXH64 of byte words. Words of up to ``longest`` bytes are remembered; everything is forgotten at
    ``limit`` words, so the memory is bounded in bytes too."""

    limit, longest = 400_000, 200

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of BASE and of its inverse modulo 2^64."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, 1 << 17)
        for name, b in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def prefix(h: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any run of items follows by :func:`run_hash`."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h))[1][: len(h)], out=out[1:])
    return out


def run_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the items [start, end), the same wherever the run stands."""
    return mix((p[end] - p[start]) * powers(len(p))[0][start])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding(op, a: np.ndarray, w: int) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``w`` consecutive elements, by doubling."""
    size = 1
    while size * 2 <= w:
        a = op(a[:-size], a[size:])
        size *= 2
    return op(a[: len(a) - (w - size)], a[w - size :]) if size < w else a


def column_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
