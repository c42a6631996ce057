"""Complete selection queries, joins with catalogues, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import blocks as B
from ..operators import polygons as P
from ..sources.points import catalogue, points
from . import stored
from .base import query
from .scalars import S_CIRC, S_RECT, XYZ

L_RECT = (200.0, 300.0, 422.0, 523.0)
DIAG = "POLYGON ((940 186, 622 461, 618 456, 936 181, 940 186))"
HOLED = "POLYGON ((300 300, 700 350, 650 720, 280 640, 300 300), (400 400, 451 400, 451 453, 400 453, 400 400))"
_RECT = "x BETWEEN 400 AND 451 AND y BETWEEN 400 AND 453"
_CIRC = "x BETWEEN 480 AND 520 AND y BETWEEN 480 AND 520 AND (x-500)*(x-500)+(y-500)*(y-500) < 400"
_D2 = "(x-500)*(x-500)+(y-500)*(y-500)"


def _edges_sql(wkt):
    out = []
    for ring in wkt[10:-2].split("), ("):
        v = [p.split() for p in ring.split(", ")]
        out += [f"SELECT CAST({a[0]} AS DOUBLE) AS x0, CAST({a[1]} AS DOUBLE) AS y0, CAST({b[0]} AS DOUBLE) AS x1, CAST({b[1]} AS DOUBLE) AS y1" for a, b in zip(v, v[1:])]
    return " UNION ALL ".join(out)


def _poly_sql(wkt, extra="TRUE"):
    side = "(x1 - x0) * (y - y0) - (x - x0) * (y1 - y0)"
    return f"WITH e AS ({_edges_sql(wkt)}), i AS (SELECT ux, uy FROM (SELECT DISTINCT ux, uy, x, y FROM points) p, e GROUP BY ux, uy HAVING sum(CASE WHEN (y0 <= y AND y1 > y AND {side} > 0) OR (y0 > y AND y1 <= y AND {side} < 0) THEN 1 ELSE 0 END) % 2 = 1) SELECT ux, uy, uz FROM points SEMI JOIN i USING (ux, uy) WHERE {extra}"


@query(f"SELECT ux, uy, uz, x, y, z FROM points WHERE {_RECT}")
def q_rectangle(spark, d):
    return P.select_rect(points(spark, d), S_RECT).select(*XYZ, "x", "y", "z")


@query("SELECT ux, uy, uz FROM points WHERE x BETWEEN 200 AND 422 AND y BETWEEN 300 AND 523 AND z >= 15 AND z <= 30")
def q_rectangle_z(spark, d):
    return P.select_rect(points(spark, d), L_RECT, 15, 30).select(*XYZ)


@query(f"SELECT ux, uy, uz FROM points WHERE {_CIRC}")
def q_circle(spark, d):
    return P.select_circle(points(spark, d), *S_CIRC).select(*XYZ)


@query(f"SELECT ux, uy, uz FROM points WHERE {_CIRC} AND z <= 10")
def q_circle_z(spark, d):
    return P.select_circle(points(spark, d), *S_CIRC, None, 10).select(*XYZ)


@query(_poly_sql(HOLED))
def q_polygon(spark, d):
    return P.select_polygon(points(spark, d), HOLED).select(*XYZ)


@query(_poly_sql(DIAG, "z >= 15"))
def q_polygon_z(spark, d):
    return P.select_polygon(points(spark, d), DIAG, 15).select(*XYZ)


@query(_poly_sql(HOLED) + " AND x BETWEEN 280 AND 700 AND y BETWEEN 300 AND 720 AND z BETWEEN 10 AND 40")
def filter_polygon(spark, d):
    """The predicate alone, beside others of the caller's."""
    p = points(spark, d).filter(F.col("z").between(10, 40))
    return p.filter(G.bbox(F.col("x"), F.col("y"), *P.box_of(HOLED)) & G.inside(G.literal_edges(HOLED), F.col("x"), F.col("y"))).select(*XYZ)


@query(_poly_sql(HOLED))
def udf_contains(spark, d):
    """The vectorised alternative to the edge join."""
    return P.select_rect(points(spark, d), P.box_of(HOLED)).filter(G.contains_udf(G.rings_of(HOLED))("x", "y")).select(*XYZ)


@query(f"SELECT ux, uy, uz, {_D2} AS d2 FROM points WHERE x BETWEEN 400 AND 600 AND y BETWEEN 400 AND 600 ORDER BY d2, ux, uy, uz LIMIT 1000")
def q_nn(spark, d):
    return P.select_nn(points(spark, d), 500, 500, 100, 1000).select(*XYZ, "d2")


@query(f"SELECT ux, uy, uz, {_D2} AS d2 FROM points WHERE x BETWEEN 490 AND 510 AND y BETWEEN 490 AND 510 ORDER BY d2, ux, uy, uz LIMIT 100")
def topk_nn(spark, d):
    return P.select_nn(points(spark, d), 500, 500, 10, 100).select(*XYZ, "d2")


@query(f"SELECT ux, uy, {_D2} AS d2 FROM points WHERE {_CIRC}")
def order_by_distance(spark, d):
    found = P.select_circle(points(spark, d), *S_CIRC)
    return found.withColumn("d2", G.dist2(F.col("x"), F.col("y"), F.lit(500), F.lit(500))).orderBy("d2", "ux", "uy").select("ux", "uy", "d2")


@query("SELECT ux, uy, uz FROM points ORDER BY k, uz, gpstime LIMIT 50")
def limit_n(spark, d):
    return points(spark, d).orderBy("k", "uz", "gpstime").limit(50).select(*XYZ)


@query("SELECT ux, uy, uz FROM points WHERE x BETWEEN 2000 AND 2100")
def q_empty(spark, d):
    return P.select_rect(points(spark, d), (2000.0, 0.0, 2100.0, 1000.0)).select(*XYZ)


_L = "FROM points WHERE x BETWEEN 200 AND 422 AND y BETWEEN 300 AND 523"


def _stats(spark, d, fns):
    return P.select_rect(points(spark, d), L_RECT).agg(*[f(F.col(c)).alias(f"stat{i}") for i, (f, c) in enumerate(fns)])


@query(f"SELECT min(z) AS stat0 {_L}")
def q_stat_min(spark, d):
    return _stats(spark, d, [(F.min, "z")])


@query(f"SELECT max(z) AS stat0 {_L}")
def q_stat_max(spark, d):
    return _stats(spark, d, [(F.max, "z")])


@query(f"SELECT avg(uz) AS stat0 {_L}")
def q_stat_avg(spark, d):
    return _stats(spark, d, [(F.avg, "uz")])


@query(f"SELECT min(x) AS stat0, max(y) AS stat1, avg(uz) AS stat2, CAST(sum(intensity) AS BIGINT) AS stat3 {_L}")
def q_stat_multi(spark, d):
    return _stats(spark, d, [(F.min, "x"), (F.max, "y"), (F.avg, "uz"), (F.sum, "intensity")])


# --- catalogue joins -----------------------------------------------------------------------------

_Z = "(qminz IS NULL OR z >= qminz) AND (qmaxz IS NULL OR z <= qmaxz)"
_REFINED = f"""WITH met AS (SELECT b.qid, b.type, b.minx, b.miny, b.maxx, b.maxy, p.ux, p.uy, p.uz, p.x, p.y, p.z FROM points p JOIN boxes b ON b.type <> 'nn' AND p.x BETWEEN b.minx AND b.maxx AND p.y BETWEEN b.miny AND b.maxy AND {_Z}),
refined AS (SELECT qid, ux, uy, uz, z FROM met WHERE type = 'rectangle' OR (type = 'circle' AND (x-(minx+maxx)/2)*(x-(minx+maxx)/2)+(y-(miny+maxy)/2)*(y-(miny+maxy)/2) < ((maxx-minx)/2)*((maxx-minx)/2))
  UNION ALL SELECT qid, ux, uy, uz, z FROM met SEMI JOIN inpoly USING (qid, ux, uy) WHERE type = 'generic') """


@query(_REFINED + "SELECT qid, ux, uy, uz FROM refined")
def join_grid_cell(spark, d):
    return P.refined(points(spark, d), catalogue(spark, d), *XYZ).select("qid", *XYZ)


@query(f"SELECT qid, ux, uy, uz FROM (SELECT b.qid, b.qminz, b.qmaxz, p.* FROM points p JOIN boxes b ON b.type = 'generic' AND p.x BETWEEN b.minx AND b.maxx AND p.y BETWEEN b.miny AND b.maxy) m SEMI JOIN inpoly USING (qid, ux, uy) WHERE {_Z}")
def join_points_polygons(spark, d):
    return P.within(points(spark, d), catalogue(spark, d), *XYZ).select("qid", *XYZ)


@query("SELECT b.qid, f.file_id FROM files f JOIN boxes b ON b.type <> 'nn' AND f.minx <= b.maxx AND f.maxx >= b.minx AND f.miny <= b.maxy AND f.maxy >= b.miny")
def join_files_query(spark, d):
    """Envelopes of headers and boxes meet in coarse grid cells and are checked there; a pair may meet in several. No
    point is read."""
    cell = 128.0
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    f = stored.envelopes(spark, d).withColumnsRenamed({c: f"f{c}" for c in ("minx", "maxx", "miny", "maxy")}).select("file_id", "fminx", "fmaxx", "fminy", "fmaxy")
    f = f.withColumn("gx", span("fminx", "fmaxx")).withColumn("gy", span("fminy", "fmaxy"))
    b = P.boxes(catalogue(spark, d).filter("type <> 'nn'")).withColumn("gx", span("minx", "maxx")).withColumn("gy", span("miny", "maxy"))
    met = b.join(f, ["gx", "gy"]).filter((F.col("fminx") <= F.col("maxx")) & (F.col("fmaxx") >= F.col("minx")) & (F.col("fminy") <= F.col("maxy")) & (F.col("fmaxy") >= F.col("miny")))
    return met.select("qid", "file_id").distinct()


@query("SELECT p.file_id, c.qid, c.wkt FROM (SELECT DISTINCT file_id, CAST(pid AS VARCHAR) AS qid FROM points) p JOIN catalogue c ON c.qid = p.qid")
def join_query_geom_by_id(spark, d):
    p = points(spark, d).select("file_id", F.col("pid").cast("string").alias("qid")).distinct()
    return p.join(catalogue(spark, d).select("qid", "wkt"), "qid").select("file_id", "qid", "wkt")


@query("SELECT CAST(least(floor((x-200)*5/222),4) AS INT) AS col, CAST(least(floor((y-300)*4/223),3) AS INT) AS row, ux, uy, uz FROM points WHERE x BETWEEN 200 AND 422 AND y BETWEEN 300 AND 523")
def join_grid_tiles(spark, d):
    """A region cut in a fishnet: every point meets one tile, by index."""
    net = fishnet(spark, 4, 5, 222 / 5, 223 / 4, 200.0, 300.0).select("row", "col")
    p = P.select_rect(points(spark, d), L_RECT).withColumns({"col": P.tiles(5, 200.0, 422.0, F.col("x")), "row": P.tiles(4, 300.0, 523.0, F.col("y"))})
    return p.join(F.broadcast(net), ["row", "col"]).select("col", "row", *XYZ)  # rows x cols given by the caller


def fishnet(spark, nrow, ncol, xsize, ysize, x0, y0):
    cells = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(nrow - 1))).alias("row")).select("row", F.explode(F.sequence(F.lit(0), F.lit(ncol - 1))).alias("col"))
    x, y = F.col("col") * xsize + x0, F.col("row") * ysize + y0
    return cells.select("row", "col", x.alias("minx"), y.alias("miny"), (x + xsize).alias("maxx"), (y + ysize).alias("maxy"))


@query("SELECT g.row, g.col, CAST(count(p.ux) AS BIGINT) AS n FROM (SELECT CAST(r.range AS INT) AS row, CAST(c.range AS INT) AS col FROM range(8) r, range(8) c) g LEFT JOIN points p ON floor(p.x/125) = g.col AND floor(p.y/125) = g.row GROUP BY g.row, g.col")
def udf_fishnet(spark, d):
    """Counts on a fishnet, empty cells kept."""
    net = fishnet(spark, 8, 8, 125.0, 125.0, 0.0, 0.0)
    n = points(spark, d).groupBy(F.floor(F.col("y") / 125).cast("int").alias("row"), F.floor(F.col("x") / 125).cast("int").alias("col")).agg(F.count("*").alias("n"))
    return net.join(n, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT row, col, CAST(row_number() OVER (ORDER BY row, col) AS INT) AS id FROM (SELECT DISTINCT CAST(floor(y/125) AS INT) AS row, CAST(floor(x/125) AS INT) AS col FROM points)")
def win_row_id(spark, d):
    """Tile ids by (row, col): one row for each occupied tile."""
    t = points(spark, d).select(F.floor(F.col("y") / 125).cast("int").alias("row"), F.floor(F.col("x") / 125).cast("int").alias("col")).distinct()
    return B.numbered(t, ("row", "col")).select("row", "col", (F.col("row_") + 1).cast("int").alias("id"))


@query(_REFINED + "SELECT c.qid, count(r.ux) AS n, min(r.z) AS minz, max(r.z) AS maxz FROM catalogue c LEFT JOIN refined r ON c.qid = r.qid WHERE c.type <> 'nn' GROUP BY c.qid")
def agg_per_query(spark, d):
    found = P.summaries(points(spark, d), catalogue(spark, d), F.count("*").alias("n"), F.min("z").alias("minz"), F.max("z").alias("maxz"))
    return found.select("qid", F.coalesce("n", F.lit(0)).alias("n"), "minz", "maxz")


@query(f"SELECT qid, ux, uy, uz, rank FROM (SELECT c.qid, c.num, p.ux, p.uy, p.uz, CAST(row_number() OVER (PARTITION BY c.qid ORDER BY (p.x-n[1])*(p.x-n[1])+(p.y-n[2])*(p.y-n[2]), ux, uy, uz) AS INT) AS rank FROM points p JOIN nums c ON c.type = 'nn' AND p.x BETWEEN n[1]-radius AND n[1]+radius AND p.y BETWEEN n[2]-radius AND n[2]+radius WHERE {_Z}) WHERE rank <= num")
def topk_nn_batch(spark, d):
    return P.nearest(points(spark, d), catalogue(spark, d)).select("qid", *XYZ, "rank")


# --- set operations ------------------------------------------------------------------------------


@query("SELECT ux, uy, uz FROM points WHERE x BETWEEN 200 AND 422 AND y BETWEEN 300 AND 523 UNION SELECT ux, uy, uz FROM points WHERE x BETWEEN 400 AND 451 AND y BETWEEN 400 AND 453")
def union_distinct(spark, d):
    p = points(spark, d)
    return P.select_rect(p, L_RECT).select(*XYZ).union(P.select_rect(p, S_RECT).select(*XYZ)).distinct()


@query("SELECT ux, uy, uz FROM points WHERE x BETWEEN 200 AND 422 AND y BETWEEN 300 AND 523 UNION ALL SELECT ux, uy, uz FROM points WHERE x BETWEEN 400 AND 451 AND y BETWEEN 400 AND 453")
def union_all_parts(spark, d):
    p = points(spark, d)
    return P.select_rect(p, L_RECT).select(*XYZ).unionByName(P.select_rect(p, S_RECT).select(*XYZ))


@query("SELECT DISTINCT ux, uy, uz, intensity FROM (SELECT * FROM points UNION ALL SELECT * FROM points WHERE x < 100)")
def agg_distinct(spark, d):
    p = points(spark, d).select(*XYZ, "intensity", "x")
    return p.unionByName(p.filter("x < 100")).select(*XYZ, "intensity").dropDuplicates()

