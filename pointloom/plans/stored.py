"""Stored layouts of the points: written once in an application, then read by the queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators.ranges import Domain
from ..operators.staging import fresh, loaded
from ..sources import las
from ..sources.points import SCALE, points

XYZ = ("ux", "uy", "uz")
CAPACITY = 500
LEVEL = 21
ORDER = ("k", "uz", "gpstime", "pid", "intensity", "red")


def sorted_by(df: DataFrame, *by: str) -> DataFrame:
    return df.repartitionByRange(B.parts_of(df), *by).sortWithinPartitions(*by)


def clustered(spark, d) -> DataFrame:
    """Flat table clustered on the key: ranges of it reach the scan as filters and prune row groups."""
    return loaded(spark, d, "clustered", lambda: sorted_by(points(spark, d).select(*XYZ, "x", "y", "z", "k"), "k"))


def domain(spark, d) -> Domain:
    """The cloud's meta, kept beside its layouts: what ranges and levels refer to."""
    ends = [f(c).cast("long").alias(f"{f.__name__}{c}") for f in (F.min, F.max) for c in ("ux", "uy")]
    found = loaded(spark, d, "meta", lambda: points(spark, d).agg(*ends)).first()
    return Domain(*(v or 0 for v in found), SCALE)


def capacity_blocks(spark, d) -> DataFrame:
    return loaded(spark, d, "capacity", lambda: B.blocks_by_capacity(points(spark, d), ORDER, CAPACITY))


def cell_blocks(spark, d) -> DataFrame:
    return loaded(spark, d, "cells", lambda: B.blocks_by_cell(points(spark, d), LEVEL))


def inventory(spark, d) -> DataFrame:
    """Headers of the cloud's LAS files, which are written beside them once."""

    def make():
        folder = fresh(spark, "las")
        las.write_las(points(spark, d), folder)
        return las.inventory(spark, folder, fresh(spark, "headers"))

    return loaded(spark, d, "inventory", make)


def envelopes(spark, d) -> DataFrame:
    """``(file_id, minx, miny, maxx, maxy)`` from the headers alone."""
    ends = [F.round(f(c), 2).alias(c) for f, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))]
    return inventory(spark, d).groupBy(F.col("source").alias("file_id")).agg(*ends)
