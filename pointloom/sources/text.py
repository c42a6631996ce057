"""Text and small binary sources: delimited points, catalogues, samples, logs and voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import listed, read_range
from .points import schema

CATALOGUE = "_id string, _key string, type string, wkt string, columns string, method string, minz double, maxz double, num int, radius int, stat string"


def read_points(spark: SparkSession, path: str, letters: str, sep: str = ",") -> DataFrame:
    """Delimited points with the declared types; a malformed row is an error."""
    return spark.read.schema(schema(letters)).csv(path, sep=sep, mode="FAILFAST")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query catalogue from XML files. Ids stay text and must be unique."""
    q = spark.read.format("xml").option("rowTag", "query").schema(CATALOGUE).load(path)
    q = q.withColumnsRenamed({"_id": "qid", "_key": "key"}).withColumn("wkt", F.trim(F.regexp_replace("wkt", r"\s+", " ")))
    repeated = q.groupBy("qid").count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"query id {repeated[0].qid} appears more than once")
    return q


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("t double, cpu double, mem double").csv(path, sep=" ")


def read_io(spark: SparkSession, path: str) -> DataFrame:
    """Wide samples `t r1 w1 r2 w2 …` under a `#dev1 dev2 …` line to rows (t, device, read, write). Every file has
    one device line of its own, of any length; another that differs is an error. Rows of a file without one are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    devices = lines.filter("value like '#%'").select("file", F.split(F.trim(F.expr("substring(value, 2)")), r"\s+").alias("devices"))
    devices = devices.groupBy("file").agg(F.min("devices").alias("devices"), F.max("devices").alias("other"))
    two = F.raise_error(F.concat(F.lit("two device lines in "), F.col("file"))).cast("array<string>")
    devices = devices.select("file", F.when(F.col("devices") == F.col("other"), F.col("devices")).otherwise(two).alias("devices"))
    rows = lines.filter("value not like '#%' and trim(value) <> ''").select("file", F.split(F.trim("value"), r"\s+").alias("v")).join(devices, "file")
    rows = rows.select(F.element_at("v", 1).cast("double").alias("t"), "v", F.posexplode("devices").alias("i", "device"))
    return rows.select("t", "device", F.element_at("v", F.col("i") * 2 + 2).cast("double").alias("read"), F.element_at("v", F.col("i") * 2 + 3).cast("double").alias("write"))


def read_loadstats(spark: SparkSession, path: str) -> DataFrame:
    """`LOADSTATS file points seconds` lines of a log; malformed ones are skipped."""
    lines = spark.read.text(path).filter("value like 'LOADSTATS%'").select(F.split("value", " ").alias("v"))
    rows = lines.selectExpr("get(v, 1) AS file", "try_cast(get(v, 2) AS bigint) AS points", "try_cast(get(v, 3) AS double) AS seconds")
    return rows.filter("points is not null and seconds is not null")


def read_voxels(spark: SparkSession, path: str, records: int = 1 << 20) -> DataFrame:
    """6-byte records of three unsigned little-endian 16-bit numbers: plane, col, row. Files are read in ranges
    of ``records``; an incomplete record at a file's end is left out."""
    n = F.floor(F.col("length") / 6)
    ranges = listed(spark, path).filter(n > 0).select("path", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(records).cast("long"))).alias("start"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, n, start in zip(*(batch.column(c).to_pylist() for c in ("path", "n", "start"))):
                values = np.frombuffer(read_range(name, start * 6, min(records, n - start) * 6), "<u2").reshape(-1, 3).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(values[:, i])) for i in range(3)], ["plane", "col", "row"])

    return ranges.repartition("path", "start").mapInArrow(run, "plane int, col int, row int")
