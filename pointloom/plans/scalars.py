"""Scans, projections, scalar functions and filters (one query for each)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import morton as M
from ..operators import blocks as B
from ..functions.geometry import edges
from ..operators.polygons import boxes, select_circle, tiles
from ..sources import las
from ..sources.points import SCALE, catalogue, dims, files, points
from . import stored
from .base import query, sql_encode, sql_gather

S_RECT = (400.0, 400.0, 451.0, 453.0)
S_CIRC = (500.0, 500.0, 20.0)
XYZ = ("ux", "uy", "uz")
LOAD_ORDER = ("k", "uz", "gpstime", "intensity", "red", "green")
_RECT = "x BETWEEN 400 AND 451 AND y BETWEEN 400 AND 453"
_CIRC_BOX = "x BETWEEN 480 AND 520 AND y BETWEEN 480 AND 520"
_CIRC = _CIRC_BOX + " AND (x-500)*(x-500)+(y-500)*(y-500) < 400"


@query("SELECT x, y, z, intensity, returnnum FROM points")
def scan_points(spark, d):
    return points(spark, d).select(*dims("xyzir"))


@query("SELECT ux, CAST(ux AS DOUBLE) / 100 AS x, CAST(trunc(CAST(ux AS DOUBLE) / 100 / 0.01) AS INT) AS back FROM points")
def scale_raw(spark, d):
    x = F.col("ux").cast("double") / 100
    return points(spark, d).select("ux", x.alias("x"), (x / 0.01).cast("int").alias("back"))


@query("WITH o AS (SELECT file_id, CAST(trunc(minx / 0.01) AS BIGINT) AS o FROM files), g AS (SELECT min(o) AS g FROM o) SELECT p.file_id, ux, CAST(ux AS BIGINT) + o - g AS gx FROM points p JOIN o ON p.file_id = o.file_id, g")
def global_raw(spark, d):
    """Raw values shifted from each file's offset to the cloud's."""
    p = points(spark, d)
    o = files(p).select("file_id", (F.col("minx") / SCALE).cast("long").alias("o"))
    g = o.agg(F.min("o").alias("g"))
    g = g.first()[0] or 0  # one number
    return p.join(o, "file_id").select("file_id", "ux", (F.col("ux").cast("long") + F.col("o") - F.lit(g)).alias("gx"))


@query(f"SELECT ux, uy, {sql_encode('ux', 'uy')} AS code FROM points")
def morton_encode(spark, d):
    return points(spark, d).select("ux", "uy", M.morton_encode(F.col("ux"), F.col("uy")).alias("code"))


@query(f"SELECT k, {sql_gather('(k >> 1)')} AS mx, {sql_gather('k')} AS my FROM points")
def morton_decode(spark, d):
    return points(spark, d).select("k", M.morton_x(F.col("k")).alias("mx"), M.morton_y(F.col("k")).alias("my"))


@query("SELECT k, CAST(ux + 1000 AS DOUBLE) * CAST(0.01 AS DOUBLE) AS rx, CAST(uy + 2000 AS DOUBLE) * CAST(0.01 AS DOUBLE) AS ry FROM points")
def morton_to_xy(spark, d):
    k = F.col("k")
    return points(spark, d).select("k", M.morton_real(M.morton_x(k), SCALE, 1000).alias("rx"), M.morton_real(M.morton_y(k), SCALE, 2000).alias("ry"))


@query(f"SELECT k, k & {((1 << 42) - 1) << 20} AS cell FROM points")
def quad_cell(spark, d):
    return points(spark, d).select("k", M.quad_cell(F.col("k"), 21).alias("cell"))


@query("SELECT DISTINCT k >> 20 AS code, (k >> 20) << 20 AS lo, (((k >> 20) + 1) << 20) - 1 AS hi FROM points")
def quad_range(spark, d):
    code = F.shiftright("k", 20)
    low, high = M.quad_range(F.col("code"), 7, 17)
    return points(spark, d).select(code.alias("code")).distinct().select("code", low.alias("lo"), high.alias("hi"))


@query(f"WITH r AS (SELECT DISTINCT (k >> 20) << 20 AS lo, (((k >> 20) + 1) << 20) - 1 AS hi FROM points) SELECT lo, hi, {sql_gather('(lo >> 1)')} AS minx, {sql_gather('lo')} AS miny, {sql_gather('(hi >> 1)')} + 1 AS maxx, {sql_gather('hi')} + 1 AS maxy FROM r")
def range_to_box(spark, d):
    r = quad_range(spark, d).drop("code")
    return r.select("lo", "hi", *M.range_box(F.col("lo"), F.col("hi")))


@query("SELECT ux, uy, CAST(least(floor(x * 8 / 1000), 7) AS INT) AS tx, CAST(least(floor(y * 8 / 1000), 7) AS INT) AS ty FROM points")
def tile_index(spark, d):
    return points(spark, d).select("ux", "uy", tiles(8, 0.0, 1000.0, F.col("x")).alias("tx"), tiles(8, 0.0, 1000.0, F.col("y")).alias("ty"))


@query("SELECT qid, minx, miny, maxx, maxy FROM boxes")
def wkt_bbox(spark, d):
    return G.with_bbox(catalogue(spark, d)).select("qid", "minx", "miny", "maxx", "maxy")


@query("SELECT qid, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy, (maxx - minx) / 2 AS rad FROM boxes WHERE type = 'circle'")
def wkt_center_radius(spark, d):
    return G.with_circle(catalogue(spark, d).filter("type = 'circle'")).select("qid", "cx", "cy", "rad")


@query("SELECT qid, ring, edge, CAST(trunc(x0 / 0.01) AS BIGINT) AS x0, CAST(trunc(y0 / 0.01) AS BIGINT) AS y0, CAST(trunc(x1 / 0.01) AS BIGINT) AS x1, CAST(trunc(y1 / 0.01) AS BIGINT) AS y1 FROM edges")
def wkt_scale(spark, d):
    return G.scaled(edges(catalogue(spark, d).filter("type <> 'nn'")), SCALE)


@query("SELECT qid, n[1] AS px, n[2] AS py FROM nums WHERE type = 'nn'")
def wkt_point(spark, d):
    return G.with_point(catalogue(spark, d).filter("type = 'nn'")).select("qid", "px", "py")


@query("SELECT qid, ring, edge, x0, y0, x1, y1 FROM edges")
def wkt_rings(spark, d):
    return edges(catalogue(spark, d).filter("type <> 'nn'"))


@query("SELECT ux, uy, (x-500)*(x-500)+(y-500)*(y-500) AS d2 FROM points")
def dist2(spark, d):
    return points(spark, d).select("ux", "uy", G.dist2(F.col("x"), F.col("y"), F.lit(500), F.lit(500)).alias("d2"))


@query("SELECT classification, classification & 31 AS class, (classification & 32) > 0 AS synthetic, (classification & 64) > 0 AS keypoint, (classification & 128) > 0 AS withheld FROM points")
def class_flags(spark, d):
    c = F.col("classification")
    flag = lambda bit: c.bitwiseAND(F.lit(bit).cast("short")) > 0
    return points(spark, d).select("classification", c.bitwiseAND(F.lit(31).cast("short")).alias("class"), flag(32).alias("synthetic"), flag(64).alias("keypoint"), flag(128).alias("withheld"))


@query("SELECT file_id, k, CAST(row_number() OVER (PARTITION BY file_id ORDER BY k, uz, gpstime, intensity, red, green) - 1 AS INT) AS m FROM points")
def vertex_index(spark, d):
    p = points(spark, d).select("file_id", *LOAD_ORDER)
    return B.numbered_within(p, "file_id", LOAD_ORDER).select("file_id", "k", F.col("row").cast("int").alias("m"))


# --- filters -------------------------------------------------------------------------------------


@query(f"SELECT ux, uy, uz FROM points WHERE {_RECT}")
def filter_bbox(spark, d):
    return points(spark, d).filter(G.bbox(F.col("x"), F.col("y"), *S_RECT)).select(*XYZ)


@query("SELECT ux, uy, uz FROM points WHERE z >= 15 AND z <= 20")
def filter_z(spark, d):
    return points(spark, d).filter(G.z_range(F.col("z"), 15, 20)).select(*XYZ)


@query(f"SELECT ux, uy, uz FROM points WHERE {_CIRC_BOX}")
def filter_circle_box(spark, d):
    return points(spark, d).filter(G.circle_box(F.col("x"), F.col("y"), *S_CIRC)).select(*XYZ)


@query(f"SELECT ux, uy, uz FROM points WHERE {_CIRC}")
def filter_circle(spark, d):
    return select_circle(points(spark, d), *S_CIRC).select(*XYZ)


@query("SELECT ux, uy, uz FROM points WHERE k BETWEEN 1000000000 AND 2000000000 OR k BETWEEN 5000000000 AND 6000000000")
def filter_morton_ranges(spark, d):
    return stored.clustered(spark, d).filter(G.in_ranges(F.col("k"), [(1_000_000_000, 2_000_000_000), (5_000_000_000, 6_000_000_000)])).select(*XYZ)


@query("SELECT ux, uy, uz FROM points WHERE (k BETWEEN 1000000000 AND 2000000000) AND z <= 10")
def filter_morton_approx(spark, d):
    return stored.clustered(spark, d).filter(G.in_ranges(F.col("k"), [(1_000_000_000, 2_000_000_000)]) & G.z_range(F.col("z"), None, 10)).select(*XYZ)


@query("SELECT f.file_id, CAST(count(*) FILTER (p.x BETWEEN 999.5 AND 1000 AND p.y BETWEEN 0 AND 500) AS BIGINT) AS n FROM files f JOIN points p ON p.file_id = f.file_id WHERE f.minx <= 1000 AND f.maxx >= 999.5 AND f.miny <= 500 AND f.maxy >= 0 GROUP BY f.file_id")
def filter_files(spark, d):
    """Files whose envelope meets a box, by their headers, then a scan whose filters open those files alone."""
    chosen = stored.envelopes(spark, d).filter("minx <= 1000 AND maxx >= 999.5 AND miny <= 500 AND maxy >= 0").select("file_id")
    files_ = stored.inventory(spark, d)
    found = las.scan(spark, files_, "XYxy").filter("x >= 999.49 AND x <= 1000.01 AND y >= -0.01 AND y <= 500.01")
    # exact on raw values: coordinates of a file are products
    hit = found.filter((F.col("ux") / 100).between(999.5, 1000) & (F.col("uy") / 100).between(0, 500)).groupBy("path").agg(F.count("*").alias("n"))
    n = files_.select("path", F.col("source").alias("file_id")).join(hit, "path").groupBy("file_id").agg(F.sum("n").alias("n"))
    return chosen.join(n, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT ux, uy, uz FROM points WHERE returnnum <= numreturnpulse AND returnnum > 0 AND (classification & 128) = 0 AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)")
def filter_invalid(spark, d):
    """Valid: coordinates are numbers, 1 <= return <= returns of the pulse, and not withheld."""
    valid = (F.col("returnnum") <= F.col("numreturnpulse")) & (F.col("returnnum") > 0) & (F.col("classification").bitwiseAND(F.lit(128).cast("short")) == 0)
    numbers = ~F.isnan("x") & ~F.isnan("y") & ~F.isnan("z") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    return points(spark, d).filter(valid & numbers).select(*XYZ)


#: Of the check of files before keys are made: the cloud's raw offset, and how far values may be off.
GLOBAL_OFFSET, TOLERANCE = 150, 1e-7
_LOW = f"{GLOBAL_OFFSET} * {SCALE}::DOUBLE"


@query(f"SELECT file_id, abs(scale - {SCALE}::DOUBLE) > {TOLERANCE} AS other_scale, 1.0::DOUBLE + least(minx, miny) - {_LOW} < {TOLERANCE} AS below, greatest(maxx, maxy) - {_LOW} > 2147483648.0::DOUBLE * {SCALE}::DOUBLE AS above FROM files WHERE other_scale OR below OR above")
def check_morton_domain(spark, d):
    """Files whose scale is not the cloud's, or whose extent from the cloud's offset on leaves [0, 2^31] raw
    units (with one unit of grace below); a caller fails if there are any."""
    low, high = F.least("minx", "miny"), F.greatest("maxx", "maxy")
    found = files(points(spark, d)).select(
        "file_id", (F.abs(F.col("scale") - SCALE) > TOLERANCE).alias("other_scale"),
        (1.0 + low - GLOBAL_OFFSET * SCALE < TOLERANCE).alias("below"), (high - GLOBAL_OFFSET * SCALE > (1 << 31) * SCALE).alias("above"),
    )
    return found.filter("other_scale or below or above")


@query('SELECT count(DISTINCT scale) AS scales, count(DISTINCT "offset") AS offsets, count(*) AS files FROM files')
def check_scale_uniform(spark, d):
    return files(points(spark, d)).agg(F.count_distinct("scale").alias("scales"), F.count_distinct("offset").alias("offsets"), F.count("*").alias("files"))


@query("SELECT qid, minx, miny, maxx, maxy FROM boxes WHERE type <> 'nn' UNION ALL SELECT qid, n[1] - radius, n[2] - radius, n[1] + radius, n[2] + radius FROM nums WHERE type = 'nn'")
def query_boxes(spark, d):
    return boxes(catalogue(spark, d)).select("qid", "minx", "miny", "maxx", "maxy")


@query("SELECT k, ux, uy FROM points WHERE x BETWEEN 200 AND 422 AND y BETWEEN 300 AND 523")
def sql_functions(spark, d):
    """Selection through the session's SQL functions on a table that keeps the key alone."""
    M.register(spark)
    points(spark, d).select("k").createOrReplaceTempView("keys_only")
    return spark.sql("SELECT k, CAST(morton_decode_x(k) AS INT) AS ux, CAST(morton_decode_y(k) AS INT) AS uy FROM keys_only WHERE morton_decode_x(k) BETWEEN 20000 AND 42200 AND morton_decode_y(k) BETWEEN 30000 AND 52300")

