"""Incremental loading with Structured Streaming: new files are taken once, enriched and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.morton import morton_encode
from ..operators.polygons import tiles
from ..operators.staging import fresh


def enrich(p: DataFrame, n: int = 8, low: float = 0.0, high: float = 1000.0) -> DataFrame:
    """Adds key and tile: the tile's number is the Morton code of its column and row."""
    tile = morton_encode(tiles(n, low, high, F.col("x")), tiles(n, low, high, F.col("y")))
    return p.withColumns({"k": morton_encode(F.col("ux"), F.col("uy")), "tile": tile.cast("int")})


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema, files_a_batch: int = 4) -> None:
    """Append the files that arrived since the last call, partitioned by tile. The checkpoint remembers what
    was taken, and the file sink commits a batch as a whole, so each point is stored once."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    run = enrich(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("tile").trigger(availableNow=True).start()
    run.awaitTermination()


def running_extent(spark: SparkSession, source: str, schema, by: str = "file_id") -> DataFrame:
    """Count and extent kept current as files arrive; returns the final state."""
    target, checkpoint = fresh(spark, "extent"), fresh(spark, "extent-checkpoint")
    ends = [f(c).alias(f"{f.__name__}{c}") for c in ("x", "y") for f in (F.min, F.max)]
    state = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source).groupBy(by).agg(F.count("*").alias("num"), *ends)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/{number}")

    run = state.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{target}/{run.lastProgress['batchId']}")
