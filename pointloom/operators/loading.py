"""Incremental loads: files in batches of bounded points, with a manifest of what is loaded.

A batch is written to a folder of its own, cut in blocks, and counts from the moment its rows stand in the manifest;
readers see the batches of the manifest alone. A batch's name follows from its files: one that failed half-way is
written over when it is tried again, one that is in the manifest is skipped without opening a file. Batches that
wait are loaded many in one pass.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.morton import morton_encode
from ..sources import las
from . import blocks as B
from .staging import bounded, staged

#: Points of a batch and of a block.
BATCH_POINTS, BLOCK_POINTS = 1_000_000, 500
#: Batches that are loaded in one pass and enter the manifest together.
ROUND_BATCHES = 64
BLOCKS = "path string, block_ix long, n long, minx double, miny double, maxx double, maxy double, pts array<struct<ux: int, uy: int, uz: int, x: double, y: double, z: double, k: long, classification: short>>, batch string"
MANIFEST = "path string, num long, batch string"
ORDER = ("k", "uz", "gpstime", "intensity", "red", "green")
LETTERS = "XYZxyzitcRG"


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """``(path, num, batch)`` of every loaded file; empty before the first load."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{target}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def batched(files: DataFrame, points: int = BATCH_POINTS) -> DataFrame:
    """Header rows with the number of their batch: files by path, cut wherever the running count of points passes a
    multiple of ``points``. A row stands for a file, so the window is over the list of files only."""
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("place", F.floor(F.coalesce(F.sum("num").over(before), F.lit(0)) / points))


def load_batch(spark: SparkSession, files: DataFrame, target: str) -> bool:
    """Load the files of header rows as one batch; False if they are loaded already. Files that an earlier batch
    loaded are left out, before any is opened."""
    return load_batches(spark, files.withColumn("place", F.lit(0).cast("long")), target) > 0


def load_batches(spark: SparkSession, files: DataFrame, target: str) -> int:
    """Load header rows with the number of their batch (``place``) in one pass over their points; the number of batches
    that were new. Each batch has a folder of its own, of about a file for each file or million points."""
    new = staged(files.dropDuplicates(["path"]).join(manifest(spark, target), "path", "left_anti"), "batch-files")
    # a set of files has one name, in whatever order they come
    found = new.groupBy("place").agg(F.sum(F.xxhash64("path").cast("decimal(38,0)")).alias("name"), F.count("*").alias("n"), F.sum("num").alias("num")).collect()
    if not found:
        return 0
    names = spark.createDataFrame([(r.place, f"{r.n}-{int(r.name) & (1 << 64) - 1:016x}") for r in found], "place long, batch string")
    batches = bounded(staged(new.join(F.broadcast(names), "place").select("path", "num", "batch"), "batches"))
    # read once: ranges would open the files for their bounds, too
    points = staged(las.records(new, LETTERS).withColumn("k", morton_encode(F.col("ux"), F.col("uy"))), "batch-points")
    parts = B.parts_of(new, sum(r.num for r in found))
    rows = B.numbered_within(points, "path", ORDER, parts).withColumn("block_ix", F.floor(F.col("row") / BLOCK_POINTS))
    rows = rows.join(batches.select("path", "batch"), "path").withColumn("_part", F.floor(F.col("row") / BATCH_POINTS)).repartition(parts, "path", "_part")
    made = B.packed(rows.groupBy("batch", "path", "_part", "block_ix")).drop("_part")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{target}/blocks")
    _commit(batches.select("path", "num", "batch"), target)
    return len(found)


def _commit(rows: DataFrame, target: str) -> None:
    """One file, moved into place whole by Spark's committer: the batch counts from then on."""
    rows.coalesce(1).write.mode("append").parquet(f"{target}/manifest")


def load(spark: SparkSession, files: DataFrame, target: str, points: int = BATCH_POINTS) -> int:
    """Load header rows in batches of about ``points``; the number of batches that were new."""
    new = staged(batched(files.dropDuplicates(["path"]).join(manifest(spark, target), "path", "left_anti"), points), "arrived")
    places = [r.place for r in new.select("place").distinct().orderBy("place").toLocalIterator()]
    rounds = [places[at : at + ROUND_BATCHES] for at in range(0, len(places), ROUND_BATCHES)]
    return sum(load_batches(spark, new.filter(F.col("place").between(r[0], r[-1])), target) for r in rounds)


def load_stream(spark: SparkSession, inventory: str, target: str, checkpoint: str, schema) -> None:
    """Load what an inventory that grows names, a batch for each of its files; Structured Streaming may repeat a batch
    after a failure, which then changes nothing."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inventory)
    run = stream.writeStream.foreachBatch(lambda files, number: load_batch(spark, files, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def loaded_blocks(spark: SparkSession, target: str) -> DataFrame:
    """The blocks of all batches in the manifest."""
    known = manifest(spark, target).select("batch").distinct()
    try:
        blocks = spark.read.schema(BLOCKS).parquet(f"{target}/blocks")
    except AnalysisException as e:
        raise ValueError(f"nothing was loaded to {target}") from e
    return blocks.join(known, "batch", "left_semi")
