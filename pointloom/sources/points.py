"""The derived point cloud, its vocabulary and the catalogue of queries over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.morton import morton_encode, sql_encode

#: Letter, column name and type of every point dimension.
DIMENSIONS = {
    "x": ("x", T.DoubleType()), "y": ("y", T.DoubleType()), "z": ("z", T.DoubleType()),
    "X": ("ux", T.IntegerType()), "Y": ("uy", T.IntegerType()), "Z": ("uz", T.IntegerType()),
    "i": ("intensity", T.IntegerType()), "r": ("returnnum", T.ShortType()), "n": ("numreturnpulse", T.ShortType()),
    "d": ("dirscanflag", T.BooleanType()), "e": ("edgeflightline", T.BooleanType()), "c": ("classification", T.ShortType()),
    "a": ("scanangle", T.ShortType()), "u": ("userdata", T.ShortType()), "p": ("pid", T.IntegerType()),
    "R": ("red", T.IntegerType()), "G": ("green", T.IntegerType()), "B": ("blue", T.IntegerType()),
    "t": ("gpstime", T.DoubleType()), "k": ("k", T.LongType()),
}
SCALE = 0.01

POINTS_SQL = f"""
SELECT *, {sql_encode('ux', 'uy')} AS k FROM (
SELECT CAST((l_orderkey*7919 + l_linenumber*104729 + l_partkey*31) % 100000 AS INT) AS ux,
       CAST((l_partkey*4099 + l_suppkey*523 + l_orderkey*17) % 100000 AS INT) AS uy,
       CAST(floor(l_quantity) * 100 AS INT) AS uz,
       CAST((l_orderkey*7919 + l_linenumber*104729 + l_partkey*31) % 100000 AS DOUBLE) / 100 AS x,
       CAST((l_partkey*4099 + l_suppkey*523 + l_orderkey*17) % 100000 AS DOUBLE) / 100 AS y,
       CAST(floor(l_quantity) AS DOUBLE) AS z,
       CAST(CAST(floor(l_extendedprice) AS BIGINT) % 65536 AS INT) AS intensity,
       CAST(l_linenumber AS SMALLINT) AS returnnum,
       CAST(l_linenumber + l_suppkey % 3 AS SMALLINT) AS numreturnpulse,
       l_linestatus = 'O' AS dirscanflag,
       l_returnflag = 'R' AS edgeflightline,
       CAST(l_partkey % 256 AS SMALLINT) AS classification,
       CAST(l_partkey % 181 - 90 AS SMALLINT) AS scanangle,
       CAST(l_suppkey % 256 AS SMALLINT) AS userdata,
       CAST(l_suppkey % 65536 AS INT) AS pid,
       CAST(l_orderkey*3 % 65536 AS INT) AS red,
       CAST(l_orderkey*5 % 65536 AS INT) AS green,
       CAST(l_orderkey*7 % 65536 AS INT) AS blue,
       CAST((extract(year FROM l_shipdate) - 1990)*372 + (extract(month FROM l_shipdate) - 1)*31
            + extract(day FROM l_shipdate) AS DOUBLE) * 86400 AS gpstime,
       CAST(l_suppkey % 16 AS INT) AS file_id
FROM lineitem) p
"""

#: A query for each supplier: rectangles, circles, polygons (each second with a hole) and neighbour searches.
CATALOGUE_SQL = """
SELECT CAST(s_suppkey AS STRING) AS qid,
       CASE s_suppkey % 4 WHEN 0 THEN 'rectangle' WHEN 1 THEN 'circle' WHEN 2 THEN 'generic' ELSE 'nn' END AS type,
       CASE s_suppkey % 4
         WHEN 3 THEN 'POINT (' || cx || ' ' || cy || ')'
         WHEN 2 THEN 'POLYGON ((' || (cx - r) || ' ' || cy || ', ' || cx || ' ' || (cy - r) || ', ' || (cx + r) || ' ' || cy || ', ' || cx || ' ' || (cy + r) || ', ' || (cx - r) || ' ' || cy
              || CASE WHEN s_suppkey % 8 = 2 THEN '), (' || (cx - 2) || ' ' || cy || ', ' || cx || ' ' || (cy - 2) || ', ' || (cx + 2) || ' ' || cy || ', ' || cx || ' ' || (cy + 2) || ', ' || (cx - 2) || ' ' || cy ELSE '' END || '))'
         ELSE 'POLYGON ((' || (cx - r) || ' ' || (cy - r) || ', ' || (cx + r) || ' ' || (cy - r) || ', ' || (cx + r) || ' ' || (cy + r) || ', ' || (cx - r) || ' ' || (cy + r) || ', ' || (cx - r) || ' ' || (cy - r) || '))'
       END AS wkt,
       CASE WHEN s_suppkey % 3 = 0 THEN 15.0 END AS minz,
       CASE WHEN s_suppkey % 5 = 0 THEN 40.0 END AS maxz,
       CAST(10 + s_suppkey % 7 AS INT) AS num,
       CAST(r AS INT) AS radius
FROM (SELECT s_suppkey, CAST(s_suppkey * 37 % 900 + 50 AS INT) AS cx, CAST(s_suppkey * 53 % 900 + 50 AS INT) AS cy, CAST(5 + s_suppkey % 20 AS INT) AS r FROM supplier) s
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points as a DataFrame over the scan of lineitem."""
    i = lambda c: F.col(f"l_{c}")
    raw_x = (i("orderkey") * 7919 + i("linenumber") * 104729 + i("partkey") * 31) % 100000
    raw_y = (i("partkey") * 4099 + i("suppkey") * 523 + i("orderkey") * 17) % 100000
    day = (F.year("l_shipdate") - 1990) * 372 + (F.month("l_shipdate") - 1) * 31 + F.dayofmonth("l_shipdate")
    found = table(spark, sf_dir, "lineitem").select(
        raw_x.cast("int").alias("ux"), raw_y.cast("int").alias("uy"), (F.floor("l_quantity") * 100).cast("int").alias("uz"),
        (raw_x.cast("double") / 100).alias("x"), (raw_y.cast("double") / 100).alias("y"), F.floor("l_quantity").cast("double").alias("z"),
        (F.floor("l_extendedprice").cast("long") % 65536).cast("int").alias("intensity"), i("linenumber").cast("short").alias("returnnum"),
        (i("linenumber") + i("suppkey") % 3).cast("short").alias("numreturnpulse"), (i("linestatus") == "O").alias("dirscanflag"), (i("returnflag") == "R").alias("edgeflightline"),
        (i("partkey") % 256).cast("short").alias("classification"), (i("partkey") % 181 - 90).cast("short").alias("scanangle"), (i("suppkey") % 256).cast("short").alias("userdata"),
        (i("suppkey") % 65536).cast("int").alias("pid"), (i("orderkey") * 3 % 65536).cast("int").alias("red"), (i("orderkey") * 5 % 65536).cast("int").alias("green"),
        (i("orderkey") * 7 % 65536).cast("int").alias("blue"), (day.cast("double") * 86400).alias("gpstime"), (i("suppkey") % 16).cast("int").alias("file_id"),
    )
    return found.withColumn("k", morton_encode(F.col("ux"), F.col("uy")))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = "catalogue_suppliers"
    table(spark, sf_dir, "supplier").createOrReplaceTempView(view)
    return spark.sql(CATALOGUE_SQL.replace("FROM supplier", f"FROM {view}"))


def files(p: DataFrame) -> DataFrame:
    """One row for each file: count, extent, and the header's scale and offset, which can differ by file."""
    ends = [f(c).alias(f"{f.__name__}{c}") for c in ("x", "y", "z") for f in (F.min, F.max)]
    return p.groupBy("file_id").agg(F.count("*").alias("num"), *ends).withColumns({"scale": F.when(F.col("num") % 3 == 0, SCALE / 10).otherwise(SCALE), "offset": F.floor("minx").cast("double")})


def dims(letters: str) -> list[Column]:
    """Columns for dimension letters; an unknown letter is an error."""
    bad = [c for c in letters if c not in DIMENSIONS]
    if bad:
        raise ValueError(f"unknown point dimensions: {bad}")
    return [F.col(DIMENSIONS[c][0]) for c in letters]


def schema(letters: str) -> T.StructType:
    return T.StructType([T.StructField(*DIMENSIONS[c]) for c in letters])
