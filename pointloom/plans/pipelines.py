"""Sources, sinks, loading and measurements (one query for each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import loading
from ..operators import polygons as P
from ..operators.staging import fresh, staged
from ..sources import las, text
from ..sources.files import name_of, write_whole
from ..sources.points import catalogue, dims, files, points, table
from ..streaming.ingest import enrich, ingest, running_extent
from .base import query, sql_encode
from .scalars import LOAD_ORDER, S_RECT, XYZ
from .selections import L_RECT
from . import stored
from .stored import clustered, sorted_by

_LRECT = "x BETWEEN 200 AND 422 AND y BETWEEN 300 AND 523"
_TILE = sql_encode("least(floor(x * 8 / 1000), 7)", "least(floor(y * 8 / 1000), 7)")

# --- sources -------------------------------------------------------------------------------------


@query("SELECT ux, uy, uz, x, intensity FROM points")
def scan_text_points(spark, d):
    path = fresh(spark, "text")
    points(spark, d).select(*dims("XYZxi")).write.csv(path)
    return text.read_points(spark, path, "XYZxi")


@query("SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY k, uz, gpstime, intensity, red, green) - 1 AS BIGINT) AS m, ux, uy, uz, intensity, classification, dirscanflag, gpstime, red FROM points")
def scan_las(spark, d):
    folder = fresh(spark, "las")
    made = las.write_las(points(spark, d), folder)
    parts = made.select("file_id", "first", name_of("path").alias("name"))
    got = las.read_las(spark, folder, "XYZicdtR").withColumn("name", name_of("path"))
    return got.join(parts, "name").select("file_id", (F.col("first") + F.col("m")).alias("m"), "ux", "uy", "uz", "intensity", "classification", "dirscanflag", "gpstime", "red")


@query("SELECT file_id, num, minx, maxx, miny, maxy FROM files")
def scan_las_headers(spark, d):
    ends = [F.round(f(c), 2).alias(c) for f, c in ((F.min, "minx"), (F.max, "maxx"), (F.min, "miny"), (F.max, "maxy"))]
    return stored.inventory(spark, d).groupBy(F.col("source").alias("file_id")).agg(F.sum("num").alias("num"), *ends)


@query("SELECT ux % 65536 AS plane, uy % 65536 AS col, uz % 65536 AS row FROM points")
def scan_voxels(spark, d):
    """Records written by tasks to the shared folder, one file each, then read in ranges."""
    folder = fresh(spark, "voxels")

    def write(parts):
        import pandas as pd
        from pyspark import TaskContext

        for i, part in enumerate(parts):
            write_whole(f"{folder}/{TaskContext.get().partitionId()}-{i}.vox", (part.to_numpy() % 65536).astype("<u2").tobytes())
            yield pd.DataFrame({"n": [len(part)]})

    points(spark, d).select(*XYZ).mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return text.read_voxels(spark, folder)


@query("SELECT qid, type, wkt, qminz AS minz, qmaxz AS maxz, num, radius FROM nums")
def scan_query_catalogue(spark, d):
    path = fresh(spark, "catalogue")
    q = catalogue(spark, d).withColumnsRenamed({"qid": "_id"})
    q.write.format("xml").option("rowTag", "query").option("rootTag", "queries").save(path)
    return text.read_queries(spark, path).select("qid", "type", "wkt", "minz", "maxz", "num", "radius")


@query("SELECT CAST(event_id AS DOUBLE) AS t, CAST(user_id % 100 AS DOUBLE) AS cpu, value AS mem FROM events")
def scan_usage_samples(spark, d):
    path = fresh(spark, "usage")
    table(spark, d, "events").select(F.concat_ws(" ", "event_id", F.col("user_id") % 100, "value").alias("value")).write.text(path)
    return text.read_usage(spark, path)


@query("SELECT CAST(event_id AS DOUBLE) AS t, CASE WHEN user_id % 4 < 2 THEN 'sda' ELSE 'nvme' || user_id % 4 END AS device, CAST(floor(value * 1000) AS DOUBLE) AS read, CAST(floor(value * 500) AS DOUBLE) AS write FROM events UNION ALL SELECT CAST(event_id AS DOUBLE), 'sdb', CAST(user_id AS DOUBLE), CAST(user_id * 2 AS DOUBLE) FROM events")
def scan_io_samples(spark, d):
    """Four machines with a file each; their device lines differ."""
    path = fresh(spark, "io")
    e = table(spark, d, "events").withColumn("machine", (F.col("user_id") % 4).cast("int"))
    lines = e.select("machine", F.lit(1).alias("place"), F.concat_ws(" ", "event_id", F.floor(F.col("value") * 1000), F.floor(F.col("value") * 500), "user_id", F.col("user_id") * 2).alias("value"))
    name = F.when(F.col("id") < 2, "sda").otherwise(F.concat(F.lit("nvme"), "id"))
    heads = spark.range(4).select(F.col("id").cast("int").alias("machine"), F.lit(0).alias("place"), F.concat(F.lit("#"), name, F.lit(" sdb")).alias("value"))
    lines.unionByName(heads).repartition("machine").sortWithinPartitions("machine", "place").drop("place").write.partitionBy("machine").text(path)
    return text.read_io(spark, path)


_SECONDS = "CASE num % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 ELSE 1.0 END"


@query(f"SELECT 'tile_' || file_id || '.las' AS file, num AS points, CAST({_SECONDS} AS DOUBLE) AS seconds FROM files")
def scan_loadstats(spark, d):
    return _loadstats(spark, d)


def _loadstats(spark, d):
    path = fresh(spark, "log")
    f = files(points(spark, d))
    good = f.select(F.concat(F.lit("LOADSTATS tile_"), "file_id", F.lit(".las "), "num", F.lit(" "), F.expr(_SECONDS).cast("double")).alias("value"))
    noise = f.select(F.concat(F.lit("LOADSTATS broken_"), "file_id", F.lit(" many")).alias("value")).unionByName(f.select(F.concat(F.lit("INFO file "), "file_id").alias("value")))
    good.unionByName(noise).write.text(path)
    return text.read_loadstats(spark, path)


# --- sinks ---------------------------------------------------------------------------------------


@query(f"SELECT ux, uy, uz FROM points WHERE {_LRECT}")
def sink_table(spark, d):
    name = "result_" + fresh(spark, "t").rpartition("-")[2]
    P.select_rect(points(spark, d), L_RECT).select(*XYZ).write.mode("overwrite").option("path", fresh(spark, name)).saveAsTable(name)
    return spark.table(name)


@query(f"SELECT count(*) AS n FROM points WHERE {_LRECT}")
def sink_stream_count(spark, d):
    """The whole result is produced and dropped; only its count is kept."""
    seen = Observation()
    P.select_rect(points(spark, d), L_RECT).observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"],)], "n long")


@query(f"SELECT ux, uy, uz FROM points WHERE {_LRECT} UNION ALL SELECT ux, uy, uz FROM points WHERE x BETWEEN 400 AND 451 AND y BETWEEN 400 AND 453")
def sink_append(spark, d):
    path, p = fresh(spark, "append"), points(spark, d)
    for region in (L_RECT, S_RECT):
        P.select_rect(p, region).select(*XYZ).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("SELECT x, y, z, classification FROM points")
def sink_text(spark, d):
    path = fresh(spark, "text")
    points(spark, d).select(*dims("xyzc")).write.option("sep", ";").option("header", True).csv(path)
    return spark.read.option("sep", ";").option("header", True).schema("x double, y double, z double, classification short").csv(path)


@query("SELECT x, intensity, gpstime FROM points")
def sink_columns(spark, d):
    return staged(points(spark, d).select(*dims("xit")), "columns")


@query(f"SELECT ux, uy, uz, k FROM points WHERE {_LRECT}")
def sink_clustered(spark, d):
    """Clustered on x and y together, so that files and row groups have tight bounds of both; read back with a
    pushed-down box that skips the others."""
    made = staged(B.clustered_on(points(spark, d).select(*XYZ, "x", "y", "k"), "x", "y"), "clustered")
    return P.select_rect(made.withColumn("z", F.lit(0.0)), L_RECT).select(*XYZ, "k")


@query("SELECT ux, uy, k FROM points WHERE k BETWEEN 1000000000 AND 2000000000")
def layout_morton(spark, d):
    """Flat table clustered on the key."""
    return clustered(spark, d).filter("k between 1000000000 and 2000000000").select("ux", "uy", "k")


@query("SELECT ux, uy, uz, k FROM points")
def sort_index(spark, d):
    return sorted_by(points(spark, d).select(*XYZ, "k"), "k")


@query("SELECT ux, uy, uz, k, classification FROM points")
def layout_flat(spark, d):
    return staged(points(spark, d).select(*XYZ, "k", "classification"), "flat")


def _tiled(spark, d):
    path = fresh(spark, "tiles")
    B.by_group(enrich(points(spark, d).select(*XYZ, "x", "y", "z")), "tile", XYZ).write.partitionBy("tile").parquet(path)
    return spark.read.parquet(path)


@query(f"SELECT CAST({_TILE} AS INT) AS tile, count(*) AS n FROM points GROUP BY 1")
def sink_partitioned_tiles(spark, d):
    return _tiled(spark, d).groupBy("tile").agg(F.count("*").alias("n"))


@query(f"SELECT ux, uy, uz FROM points WHERE CAST({_TILE} AS INT) IN (12, 13)")
def layout_tiles(spark, d):
    """Read back two tiles: the others' folders are never opened."""
    return _tiled(spark, d).filter("tile in (12, 13)").select(*XYZ)


# --- loading -------------------------------------------------------------------------------------


#: Points of an arriving file_id's part.
ARRIVING_ROWS = 1_000_000


def _arriving(spark, d):
    """Files of points as they would arrive, one or more for each file_id; none of more than some millions of points."""
    return staged(B.by_group(points(spark, d).drop("k"), "file_id", (*XYZ, "gpstime"), ARRIVING_ROWS), "arriving")


def _source(df: DataFrame) -> str:
    return df.inputFiles()[0].rpartition("/")[0]


@query(f"SELECT ux, uy, uz, k, CAST({_TILE} AS INT) AS tile FROM points")
def stream_ingest_points(spark, d):
    a = _arriving(spark, d)
    target, checkpoint = fresh(spark, "ingested"), fresh(spark, "checkpoint")
    ingest(spark, _source(a), target, checkpoint, a.schema)
    ingest(spark, _source(a), target, checkpoint, a.schema)  # nothing new: nothing is taken twice
    return spark.read.parquet(target).select(*XYZ, "k", F.col("tile").cast("int").alias("tile"))


@query("SELECT file_id, num, minx, maxx, miny, maxy FROM files")
def stream_running_extent(spark, d):
    a = _arriving(spark, d)
    return running_extent(spark, _source(a), a.schema).select("file_id", "num", "minx", "maxx", "miny", "maxy")


@query("SELECT ux, uy, uz FROM points")
def load_incremental(spark, d):
    """Arriving files in batches of points, each cut in blocks and committed to a manifest; the second load names all
    files again and opens none of them."""
    arrived, target = stored.inventory(spark, d), fresh(spark, "loaded")
    some = arrived.filter("source % 2 = 0")
    for files_ in (some, arrived, arrived):
        loading.load(spark, files_, target)
    return B.explode_blocks(loading.loaded_blocks(spark, target)).select(*XYZ)


@query("SELECT file_id, CAST(floor((row_number() OVER (PARTITION BY file_id ORDER BY k, uz, gpstime, intensity, red, green) - 1) / 100) AS BIGINT) AS block_ix, ux, uy, uz FROM points")
def load_ordered(spark, d):
    """Blocks keep their place: ordering columns instead of a serial load."""
    p = B.numbered_within(points(spark, d).select("file_id", *XYZ, *(c for c in LOAD_ORDER if c not in XYZ)), "file_id", LOAD_ORDER)
    return staged(sorted_by(p.select("file_id", F.floor(F.col("row") / 100).alias("block_ix"), *XYZ), "file_id", "block_ix"), "ordered")


# --- measurements --------------------------------------------------------------------------------

_USAGE = "WITH u AS (SELECT CAST(user_id % 4 AS INT) AS device, event_id AS t, CAST(floor(value * 1000) AS BIGINT) AS r, CAST(floor(value * 500) AS BIGINT) AS w FROM events) "


def _usage(spark, d):
    e = table(spark, d, "events")
    return e.select((F.col("user_id") % 4).cast("int").alias("device"), F.col("event_id").alias("t"), F.floor(F.col("value") * 1000).alias("r"), F.floor(F.col("value") * 500).alias("w"))


@query(_USAGE + "SELECT device, t, CAST(r - lag(r) OVER (PARTITION BY device ORDER BY t) AS DOUBLE) / (t - lag(t) OVER (PARTITION BY device ORDER BY t)) / 1048576 AS rate FROM u")
def win_io_rate(spark, d):
    """A sample meets the one before by its number, so that a device is not one task."""
    u = staged(B.numbered_within(_usage(spark, d).select("device", "t", "r"), "device", ("t", "r")).select("device", "t", "r", "row"), "samples")
    last = u.select("device", (F.col("row") + 1).alias("row"), F.col("t").alias("t0"), F.col("r").alias("r0"))
    return u.join(last, ["device", "row"], "left").select("device", "t", ((F.col("r") - F.col("r0")).cast("double") / (F.col("t") - F.col("t0")) / 1048576).alias("rate"))


@query(_USAGE + "SELECT device, t, t - min(t) OVER (PARTITION BY device) AS elapsed FROM u")
def win_elapsed(spark, d):
    u = _usage(spark, d)
    first = u.groupBy("device").agg(F.min("t").alias("t0"))
    return u.join(first, "device").select("device", "t", (F.col("t") - F.col("t0")).alias("elapsed"))


@query(_USAGE + ", c AS (SELECT *, ntile(20) OVER (PARTITION BY device ORDER BY t) AS chunk FROM u) SELECT device, CAST(chunk AS INT) AS chunk, CAST(sum(r) AS DOUBLE) / count(*) AS mean FROM c GROUP BY device, chunk")
def win_chunked_mean(spark, d):
    """20 near-equal chunks by row number: the first ``n % 20`` chunks are longer by one."""
    u = B.numbered_within(_usage(spark, d).select("device", "t", "r"), "device", ("t", "r"))
    size, longer, row = F.floor(F.col("of") / 20), F.col("of") % 20, F.col("row")
    chunk = F.when(row < longer * (size + 1), F.floor(row / (size + 1))).otherwise(longer + F.floor((row - longer * (size + 1)) / F.greatest(size, F.lit(1))))
    return u.groupBy("device", (chunk + 1).cast("int").alias("chunk")).agg((F.sum("r").cast("double") / F.count("*")).alias("mean"))


@query("SELECT file_id, num, CAST(sum(num) OVER (ORDER BY file_id) AS BIGINT) AS total FROM files")
def win_cumulative(spark, d):
    return files(points(spark, d)).select("file_id", "num", F.sum("num").over(Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, 0)).alias("total"))  # a row a file


_RUNS = "WITH runs AS (SELECT event_type AS approach, CAST(user_id % 7 AS INT) AS query, CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(user_id % 7 * 10 + CASE WHEN user_id % 7 = 3 THEN event_id % 2 ELSE 0 END AS VARCHAR) END AS result, CAST(floor(value * 100) AS BIGINT) AS ms, CAST(1 + event_id % 4 AS INT) AS users FROM events) "


def _runs(spark, d):
    user, event = F.col("user_id") % 7, F.col("event_id")
    odd = F.when(user == 3, event % 2).otherwise(0)
    return table(spark, d, "events").select(F.col("event_type").alias("approach"), user.cast("int").alias("query"), F.when(event % 11 == 0, "n/a").otherwise((user * 10 + odd).cast("string")).alias("result"), F.floor(F.col("value") * 100).alias("ms"), (1 + event % 4).cast("int").alias("users"))


@query(_RUNS + "SELECT approach, query, CAST(sum(coalesce(try_cast(result AS BIGINT), -1)) AS DOUBLE) / count(*) AS result, CAST(sum(ms) AS DOUBLE) / count(*) AS ms, min(coalesce(try_cast(result AS BIGINT), -1)) <> max(coalesce(try_cast(result AS BIGINT), -1)) AS differs FROM runs GROUP BY approach, query")
def agg_run_means(spark, d):
    """Means of an approach's runs; what is no number counts as -1; ``differs`` marks unequal results."""
    r = _runs(spark, d).withColumn("v", F.coalesce(F.expr("try_cast(result AS bigint)"), F.lit(-1)))
    mean = lambda c: F.sum(c).cast("double") / F.count("*")
    return r.groupBy("approach", "query").agg(mean("v").alias("result"), mean("ms").alias("ms"), (F.min("v") != F.max("v")).alias("differs"))


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query(_RUNS + "SELECT query, " + ", ".join(f"CAST(sum(ms) FILTER (approach = '{a}') AS DOUBLE) / count(*) FILTER (approach = '{a}') AS \"{a}\"" for a in _KINDS) + " FROM runs GROUP BY query")
def agg_run_pivot(spark, d):
    return _runs(spark, d).groupBy("query").pivot("approach", _KINDS).agg(F.sum("ms").cast("double") / F.count("ms"))


@query(_RUNS + "SELECT users, " + ", ".join(f"CAST(sum(ms) FILTER (query = {q}) AS DOUBLE) / count(*) FILTER (query = {q}) AS q{q}" for q in range(7)) + " FROM runs GROUP BY users")
def agg_multi_user(spark, d):
    wide = _runs(spark, d).groupBy("users").pivot("query", list(range(7))).agg(F.sum("ms").cast("double") / F.count("ms"))
    return wide.withColumnsRenamed({str(q): f"q{q}" for q in range(7)})


@query("WITH s AS (SELECT file_id AS approach, num, CAST(num % 50 + 1 AS DOUBLE) AS init, CAST(num % 30 + 1 AS DOUBLE) AS close, CAST(num + 100 AS DOUBLE) AS total, CAST(num % 90 + 10 AS DOUBLE) AS mb FROM files) SELECT approach, total - (init + close) AS load, CAST(floor(num / total + 0.5) AS BIGINT) AS points_s, CAST(floor(num / mb + 0.5) AS BIGINT) AS points_mb FROM s")
def agg_load_summary(spark, d):
    """From tagged log values of each approach: load = total - (init + close), points a second and a MB."""
    n = F.col("num")
    tags = {"initialize": n % 50 + 1, "close": n % 30 + 1, "total": n + 100, "size": n % 90 + 10, "points": n}
    log = files(points(spark, d)).select(F.col("file_id").alias("approach"), F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), v.cast("double").alias("v")) for t, v in tags.items()])).alias("e")).select("approach", "e.*")
    one = log.groupBy("approach").agg(*[F.max(F.when(F.col("tag") == t, F.col("v"))).alias(t) for t in tags])
    return one.select("approach", (F.col("total") - (F.col("initialize") + F.col("close"))).alias("load"), F.floor(F.col("points") / F.col("total") + 0.5).alias("points_s"), F.floor(F.col("points") / F.col("size") + 0.5).alias("points_mb"))


@query(_USAGE + ", e AS (SELECT *, t - min(t) OVER (PARTITION BY device) AS tr FROM u), p AS (SELECT *, CASE WHEN tr <= 100 THEN 'init' WHEN tr <= 400 THEN 'load' ELSE 'close' END AS phase FROM e) SELECT device, phase, CAST(sum(r) AS DOUBLE) / count(*) AS mean, min(r) AS low, max(r) AS high FROM p GROUP BY device, phase")
def agg_phase_usage(spark, d):
    e = _usage(spark, d).join(win_elapsed(spark, d), ["device", "t"])
    phase = F.when(F.col("elapsed") <= 100, "init").when(F.col("elapsed") <= 400, "load").otherwise("close")
    return e.groupBy("device", phase.alias("phase")).agg((F.sum("r").cast("double") / F.count("*")).alias("mean"), F.min("r").alias("low"), F.max("r").alias("high"))


@query(f"SELECT count(*) AS files, CAST(sum(num) AS BIGINT) AS points, sum(num / {_SECONDS}) FILTER ({_SECONDS} > 0) / count(*) FILTER ({_SECONDS} > 0) AS speed FROM files")
def agg_load_speed(spark, d):
    """Points a second of every file in the log, averaged without the infinite ones."""
    return _loadstats(spark, d).agg(F.count("*").alias("files"), F.sum("points").alias("points"), F.avg(F.when(F.col("seconds") > 0, F.col("points") / F.col("seconds"))).alias("speed"))

