"""Uncompressed LAS files, point formats 0 to 3.

Headers are read file by file into an inventory, point records in ranges of records, so that a large file is many
tasks. Which files to read is chosen from the inventory: by a filter of it, or by the data source ``las``, whose
filters on coordinates drop the files whose envelope they miss. Files that are not chosen are never opened.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.blocks import parts_of
from ..operators.staging import fresh, staged, tasks_of
from .files import listed, read_range, write_whole
from .points import DIMENSIONS, schema

HEADER = "path string, source int, num long, point_offset long, format int, length int, scalex double, scaley double, scalez double, offsetx double, offsety double, offsetz double, minx double, miny double, minz double, maxx double, maxy double, maxz double"
RANGE = 1 << 18
#: Records of a file that is written.
PART_POINTS = 1 << 20
#: Fields of the public point record layouts.
_BASE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("i", "<u2"), ("flags", "u1"), ("c", "u1"), ("a", "i1"), ("u", "u1"), ("p", "<u2")]
_TIME, _COLOUR = [("t", "<f8")], [("R", "<u2"), ("G", "<u2"), ("B", "<u2")]
FORMATS = {0: _BASE, 1: _BASE + _TIME, 2: _BASE + _COLOUR, 3: _BASE + _TIME + _COLOUR}


def _header(path: str) -> dict:
    b = read_range(path, 0, 227)
    if b[:4] != b"LASF":
        raise ValueError(f"{path} is no LAS file")
    source, = struct.unpack_from("<H", b, 4)
    offset, = struct.unpack_from("<I", b, 96)
    kind, length, num = struct.unpack_from("<BHI", b, 104)
    if kind not in FORMATS:
        raise ValueError(f"{path} has point records of format {kind}; formats {min(FORMATS)} to {max(FORMATS)} are read")
    sx, sy, sz, ox, oy, oz, hx, lx, hy, ly, hz, lz = struct.unpack_from("<12d", b, 131)
    return {"path": path, "source": source, "num": num, "point_offset": offset, "format": kind, "length": length, "scalex": sx, "scaley": sy, "scalez": sz, "offsetx": ox, "offsety": oy, "offsetz": oz, "minx": lx, "miny": ly, "minz": lz, "maxx": hx, "maxy": hy, "maxz": hz}


def _headers(found: DataFrame) -> DataFrame:
    todo = found.select("path").repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(parts):
        for part in parts:
            yield pd.DataFrame([_header(p) for p in part["path"]], columns=[x.split()[0] for x in HEADER.split(", ")])

    return todo.mapInPandas(run, HEADER)


def read_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each file, by its path."""
    return _headers(listed(spark, paths))


def inventory(spark: SparkSession, paths: str | list[str], at: str) -> DataFrame:
    """The headers of all files listed, kept at ``at`` with the files' sizes and times: only files that are new there or
    have changed are opened, files that are gone are left out."""
    now = listed(spark, paths).withColumnRenamed("length", "bytes")
    try:
        known = spark.read.parquet(at)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    fresh_ = now if known is None else now.join(known, ["path", "bytes", "modified"], "left_anti")
    fresh_ = staged(fresh_, "new-files")
    if known is None or not fresh_.isEmpty():
        _headers(fresh_).join(fresh_, "path").write.mode("append").parquet(at)
    return spark.read.parquet(at).join(now, ["path", "bytes", "modified"], "left_semi")


def _records(path: str, h, start: int, count: int) -> pd.DataFrame:
    fields = FORMATS[int(h.format)]
    kind = np.dtype({"names": [n for n, _ in fields], "formats": [t for _, t in fields], "offsets": list(np.cumsum([0] + [np.dtype(t).itemsize for _, t in fields])[:-1]), "itemsize": int(h.length)})
    raw = np.frombuffer(read_range(path, int(h.point_offset) + start * int(h.length), count * int(h.length)), kind)
    get = lambda c: raw[c] if c in kind.names else np.zeros(len(raw))
    flags = raw["flags"]
    out = {c: get(c) for c in "XYZicauptRGB"} | {"r": flags & 7, "n": flags >> 3 & 7, "d": (flags >> 6 & 1).astype(bool), "e": (flags >> 7).astype(bool)}
    out |= {"x": raw["X"] * h.scalex + h.offsetx, "y": raw["Y"] * h.scaley + h.offsety, "z": raw["Z"] * h.scalez + h.offsetz}
    return pd.DataFrame(out)


def read_las(spark: SparkSession, paths: str | list[str], letters: str = "xyz", skip_invalid: bool = False) -> DataFrame:
    """The records of files: see :func:`records`."""
    return records(read_headers(spark, paths), letters, skip_invalid)


def _types(letters: str) -> str:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema(letters).fields)
    return f"path string, m long, {fields}"


def _frame(h, start: int, count: int, wanted: str, skip_invalid: bool = False) -> pd.DataFrame:
    got = _records(h.path, h, start, count)
    out = pd.DataFrame({"path": h.path, "m": start + np.arange(len(got))} | {DIMENSIONS[c][0]: got[c].to_numpy() for c in wanted})
    return out[((got["r"] <= got["n"]) & (got["r"] > 0) | (got["n"] == 0)).to_numpy()] if skip_invalid else out


def records(headers: DataFrame, letters: str = "xyz", skip_invalid: bool = False) -> DataFrame:
    """``(path, m, dimensions…)`` of the files that ``headers`` names, and no others; ``m`` is the record's place in
    its file. The key ``k`` is left to :func:`..functions.morton.morton_encode`. Invalid records (return above the
    pulse's returns, or 0 of some) may be skipped."""
    ranges = headers.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("num") - 1, F.lit(0)), F.lit(RANGE).cast("long")))).filter("num > 0")
    # a number, as these few bytes, which become many rows, would else be one task
    ranges = ranges.repartition(tasks_of(headers.sparkSession), "path", "start")
    wanted = letters.replace("k", "")

    def run(parts):
        for part in parts:
            for h in part.itertuples():
                yield _frame(h, int(h.start), int(min(RANGE, h.num - h.start)), wanted, skip_invalid)

    return ranges.mapInPandas(run, _types(wanted))


class Asked(NamedTuple):
    """What a pushed filter asks of an axis: values from ``low`` to ``high``."""

    axis: str
    low: float
    high: float


def _asked(f) -> Asked | None:
    if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or f.attribute not in (("x",), ("y",), ("z",)):
        return None
    low = f.value if not isinstance(f, (LessThan, LessThanOrEqual)) else float("-inf")
    high = f.value if not isinstance(f, (GreaterThan, GreaterThanOrEqual)) else float("inf")
    return Asked(f.attribute[0], float(low), float(high))


class Records(InputPartition):
    def __init__(self, header: dict, start: int, count: int):
        self.header, self.start, self.count = header, start, count


class LasReader(DataSourceReader):
    """Files of an inventory, less those whose envelope the pushed filters miss. Spark still applies the filters."""

    def __init__(self, options: dict):
        self.options, self.asked = options, []

    def pushFilters(self, filters):
        self.asked = [a for a in map(_asked, filters) if a]
        yield from filters

    def partitions(self):
        import json

        out = []
        for line in read_range(self.options["headers"], 0, 1 << 40).decode().splitlines():
            h = json.loads(line)
            near = 1e-6  # envelopes are rounded as their writer did
            if all(h[f"min{a.axis}"] - near <= a.high and h[f"max{a.axis}"] + near >= a.low for a in self.asked):
                out += [Records(h, at, min(RANGE, h["num"] - at)) for at in range(0, h["num"], RANGE)]
        return out

    def read(self, partition):
        from types import SimpleNamespace

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import LongType, StringType, StructField, StructType

        if partition is None:  # no file is left
            return
        kinds = to_arrow_schema(StructType([StructField("path", StringType()), StructField("m", LongType()), *schema(self.options["letters"]).fields]))
        frame = _frame(SimpleNamespace(**partition.header), partition.start, partition.count, self.options["letters"])
        for at in range(0, len(frame), 1 << 16):
            yield pa.RecordBatch.from_pandas(frame.iloc[at : at + (1 << 16)], schema=kinds, preserve_index=False)


class LasSource(DataSource):
    """``spark.read.format("las")`` with options ``headers`` (a file of header rows as JSON lines) and ``letters``."""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return _types(self.options.get("letters", "xyz"))

    def reader(self, schema):
        return LasReader({"letters": "xyz"} | dict(self.options))


def scan(spark: SparkSession, headers: DataFrame, letters: str = "xyz") -> DataFrame:
    """The files of an inventory as a data source: filters on x, y and z choose the files to open. The list of files
    is planned on the driver, as any scan's is; filter the inventory itself where it is too long for that."""
    spark.dataSource.register(LasSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = fresh(spark, "headers") + ".json"
    write_whole(path, "\n".join(headers.toJSON().toLocalIterator()).encode())
    return spark.read.format("las").option("headers", path).option("letters", letters.replace("k", "")).load()


ORDER = ("k", "uz", "gpstime", "intensity", "red", "green")


def _written(part: pd.DataFrame, path: str, scale: float) -> None:
    raw = np.zeros(len(part), np.dtype(FORMATS[3]))
    for c in "XYZicauptRGB":
        raw[c] = part[DIMENSIONS[c][0]].to_numpy().astype(raw.dtype[c], casting="unsafe")
    raw["flags"] = (part["returnnum"].to_numpy() & 7) | (part["numreturnpulse"].to_numpy() & 7) << 3 | part["dirscanflag"].to_numpy().astype(int) << 6 | part["edgeflightline"].to_numpy().astype(int) << 7
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, 2])
    struct.pack_into("<H", head, 4, int(part["file_id"].iloc[0]))
    struct.pack_into("<HI", head, 94, 227, 227)
    struct.pack_into("<BHI", head, 104, 3, raw.dtype.itemsize, len(raw))
    ends = [v for c in ("ux", "uy", "uz") for v in (part[c].max() * scale, part[c].min() * scale)]
    struct.pack_into("<12d", head, 131, scale, scale, scale, 0, 0, 0, *ends)
    write_whole(path, bytes(head) + raw.tobytes())


def write_las(p: DataFrame, folder: str, scale: float = 0.01) -> DataFrame:
    """Files of format 3 of up to PART_POINTS records, one or more for each ``file_id``, in the order of the
    key: ``(file_id, path, num, first)``, ``first`` being the records of the file_id in the files before.
    Ranges of the order are written where they are sorted; ``folder`` must be a shared path. The id stands in the
    header as the file source ID and so must fit into 16 bits."""

    def run(parts):
        from pyspark import TaskContext

        part_id, made = TaskContext.get().partitionId(), 0
        held, rows = [], 0  # put together once they fill a file

        def full(table, last):
            nonlocal made
            while len(table) and (last or len(table) >= PART_POINTS or table["file_id"].iloc[0] != table["file_id"].iloc[-1]):
                fid = table["file_id"].iloc[0]
                n = min(int((table["file_id"].to_numpy() == fid).sum()), PART_POINTS)
                path = f"{folder}/part_{fid}_{part_id:06d}_{made:06d}.las"
                _written(table.iloc[:n], path, scale)
                yield pd.DataFrame({"file_id": [int(fid)], "path": [path], "num": [n], "place": [part_id << 20 | made]})
                made, table = made + 1, table.iloc[n:]
            return table

        for part in parts:
            if not len(part):
                continue
            held.append(part)
            rows += len(part)
            if rows >= PART_POINTS or held[0]["file_id"].iloc[0] != part["file_id"].iloc[-1]:
                held = [(yield from full(pd.concat(held), False))]
                rows = len(held[0])
                held = held if rows else []
        if held:
            yield from full(pd.concat(held), True)

    ranged = p.repartitionByRange(parts_of(p), "file_id", *ORDER).sortWithinPartitions("file_id", *ORDER)
    made = ranged.mapInPandas(run, "file_id int, path string, num long, place long")
    # written once: to run it again would write the files again
    before = Window.partitionBy("file_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return staged(made, "las-files").select("file_id", "path", "num", F.coalesce(F.sum("num").over(before), F.lit(0)).alias("first"))
