"""Files that tasks read and write by ranges of bytes, wherever pyarrow's file systems reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(path: str):
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:") :]  # as Spark writes local paths
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_range(path: str, start: int, count: int) -> bytes:
    where, name = _at(path)
    with where.open_input_file(name) as f:
        return f.read_at(min(count, max(f.size() - start, 0)), start)


def write_whole(path: str, content: bytes) -> None:
    """A task that runs again writes the same file in the same place."""
    where, name = _at(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    with where.open_output_stream(name) as f:
        f.write(content)


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, length, modified)`` of a file, several, a folder, a pattern, or of a list file `@file`. Spark lists them."""
    if isinstance(paths, str) and paths.startswith("@"):
        names = [r.value.strip() for r in spark.read.text(paths[1:]).collect()]  # a line a file
        paths = [n for n in names if n]
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.col("modificationTime").alias("modified"))


def name_of(path):
    return F.element_at(F.split(path, "/"), -1)
