"""Tables written to the shared folder, so that what is read twice is computed once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of up to so many bytes, as estimated from their values, are broadcast.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-points-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str, **options) -> DataFrame:
    path = fresh(df.sparkSession, tag)
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_of(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame) -> DataFrame:
    """Few bytes that become much work or many rows: dealt to as many tasks as a shuffle has, not left in the one or two that
    their bytes alone would make."""
    return df.repartition(tasks_of(df.sparkSession))


def bounded(table: DataFrame) -> DataFrame:
    """A staged table, marked for broadcast if its values, added up, keep within BROADCAST_BYTES; beyond that Spark
    shuffles it by the join's keys."""
    sizes = []
    for f in table.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long"))
        elif kind == "array":
            each = 8 * len(f.dataType.elementType.fields) if f.dataType.elementType.typeName() == "struct" else 8
            sizes.append((F.greatest(F.size(f.name), F.lit(0)) * each).cast("long"))
    weight = sum(sizes, F.lit(24 + 8 * len(table.columns)).cast("long"))
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


_loaded: dict[tuple, str] = {}


def _version(spark: SparkSession, path: str) -> tuple[int, int]:
    """Modification time and bytes of a table's files, from the file system alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.getFileStatus(at).getModificationTime(), fs.getContentSummary(at).getLength()


def loaded(spark: SparkSession, sf_dir: str, layout: str, make: Callable[[], DataFrame], *by: str) -> DataFrame:
    """A stored layout of the points: written at its first use in an application, then read by every query,
    as a loader and its queries share a table. It is written anew when the points' table has changed."""
    key = (spark.sparkContext.applicationId, sf_dir, layout, _version(spark, f"{sf_dir}/lineitem.parquet"))
    if key not in _loaded:
        path = fresh(spark, layout)
        writer = make().write
        (writer.partitionBy(*by) if by else writer).parquet(path)
        _loaded[key] = path
    return spark.read.parquet(_loaded[key])
