"""Aggregations, windows, layouts, Morton ranges and blocks (one query for each)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import polygons as P
from ..operators import ranges as R
from ..functions import morton as M
from ..functions.geometry import in_ranges, inside, literal_edges
from ..functions.morton import quad_cell
from ..operators.staging import bounded, dealt, staged
from ..sources.points import SCALE, catalogue, files, points
from . import stored
from .base import query, sql_encode
from .scalars import S_CIRC, S_RECT, XYZ
from .selections import HOLED, L_RECT, _poly_sql
from .stored import CAPACITY, LEVEL

_RECT = "x BETWEEN 400 AND 451 AND y BETWEEN 400 AND 453"
_LRECT = "x BETWEEN 200 AND 422 AND y BETWEEN 300 AND 523"

# --- aggregations --------------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM points")
def agg_count(spark, d):
    return points(spark, d).agg(F.count("*").alias("n"))


@query("SELECT min(ux) AS minx, max(ux) AS maxx, avg(uz) AS avgz, CAST(sum(intensity) AS BIGINT) AS sumi FROM points")
def agg_stats(spark, d):
    return points(spark, d).agg(F.min("ux").alias("minx"), F.max("ux").alias("maxx"), F.avg("uz").alias("avgz"), F.sum("intensity").alias("sumi"))


@query("SELECT CAST(sum(num) AS BIGINT) AS num, min(minx) AS minx, max(maxx) AS maxx, min(miny) AS miny, max(maxy) AS maxy, min(minz) AS minz, max(maxz) AS maxz FROM files WHERE num > 0")
def agg_cloud_extent(spark, d):
    ends = [f(f"{f.__name__}{c}").alias(f"{f.__name__}{c}") for c in "xyz" for f in (F.min, F.max)]
    return files(points(spark, d)).filter("num > 0").agg(F.sum("num").alias("num"), *ends)


@query("SELECT 'points' AS tablename, CAST(28992 AS INT) AS srid, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, CAST(0.01 AS DOUBLE) AS scalex, CAST(0.01 AS DOUBLE) AS scaley FROM points")
def agg_meta(spark, d):
    return points(spark, d).agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy")).select(F.lit("points").alias("tablename"), F.lit(28992).alias("srid"), "minx", "miny", "maxx", "maxy", F.lit(SCALE).alias("scalex"), F.lit(SCALE).alias("scaley"))


_COLUMNS = ["ux", "uy", "uz", "intensity", "returnnum", "numreturnpulse", "classification", "scanangle", "userdata", "pid", "red", "green", "blue", "k"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, CAST(min({c}) AS BIGINT) AS low, CAST(max({c}) AS BIGINT) AS high FROM points" for c in _COLUMNS))
def agg_minmax_columns(spark, d):
    """All columns in one pass, unpivoted."""
    one = points(spark, d).agg(*[f(c).cast("long").alias(f"{f.__name__}_{c}") for c in _COLUMNS for f in (F.min, F.max)])
    parts = ", ".join(f"'{c}', min_{c}, max_{c}" for c in _COLUMNS)
    return one.select(F.expr(f"stack({len(_COLUMNS)}, {parts}) AS (name, low, high)"))


@query("SELECT 'return' AS kind, CAST(greatest(returnnum, 1) AS INT) AS slot, count(*) AS n FROM points GROUP BY 2 UNION ALL SELECT 'pulse', CAST(numreturnpulse AS INT), count(*) FROM points GROUP BY 2 UNION ALL SELECT 'class', CAST(classification & 31 AS INT), count(*) FROM points GROUP BY 2 UNION ALL SELECT 'flag', CAST(f AS INT), count(*) FROM points, (VALUES (32), (64), (128)) v(f) WHERE (classification & f) > 0 GROUP BY 2 UNION ALL SELECT 'all', 0, count(*) FROM points")
def agg_point_summary(spark, d):
    """Histograms of returns, pulses, classes and flags in one pass: each point is counted in each kind."""
    c = F.col("classification").cast("int")
    flags = [F.when(c.bitwiseAND(F.lit(bit)) > 0, F.struct(F.lit("flag").alias("kind"), F.lit(bit).alias("slot"))) for bit in (32, 64, 128)]
    slot = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.cast("int").alias("slot"))
    # return number 0 counts in slot 1
    kinds = F.array(slot("return", F.greatest(F.col("returnnum").cast("int"), F.lit(1))), slot("pulse", F.col("numreturnpulse")), slot("class", c.bitwiseAND(F.lit(31))), slot("all", F.lit(0)), *flags)
    return points(spark, d).select(F.explode(kinds).alias("s")).filter("s is not null").groupBy("s.kind", "s.slot").agg(F.count("*").alias("n"))


@query("SELECT floor(intensity / 4096) AS bin, count(*) AS n FROM points GROUP BY 1")
def agg_histogram(spark, d):
    return points(spark, d).groupBy(F.floor(F.col("intensity") / 4096).cast("double").alias("bin")).agg(F.count("*").alias("n"))


_CELLS = f"WITH cells AS (SELECT k & {((1 << 42) - 1) << 20} AS cell, count(*) AS n, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM points GROUP BY 1) "


def _cells(spark, d):
    return stored.cell_blocks(spark, d)


@query(_CELLS + "SELECT * FROM cells")
def agg_block_by_cell(spark, d):
    """The aggregation alone: counts and extents of cells, without gathering their points."""
    ends = [f(c).alias(f"{f.__name__}{c}") for f in (F.min, F.max) for c in ("x", "y")]
    return points(spark, d).groupBy(quad_cell(F.col("k"), LEVEL).alias("cell")).agg(F.count("*").alias("n"), *ends)


@query(_CELLS + "SELECT CAST(sum(n) AS BIGINT) AS points, count(*) AS cells FROM cells")
def agg_block_points(spark, d):
    return _cells(spark, d).agg(F.sum("n").alias("points"), F.count_distinct("cell").alias("cells"))


# --- windows -------------------------------------------------------------------------------------


@query("WITH b AS (SELECT DISTINCT k >> 18 AS id FROM points WHERE x < 500), g AS (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM b) SELECT min(id) AS lo, max(id) AS hi FROM g GROUP BY g")
def win_islands_ids(spark, d):
    """Sorted block ids to runs of consecutive ones: in a run, id less row number stays the same."""
    b = points(spark, d).filter("x < 500").select(F.shiftright("k", 18).alias("id")).distinct()
    runs = B.numbered(b, ("id",)).groupBy((F.col("id") - F.col("row_")).alias("g"))
    return runs.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).select("lo", "hi")


def _runs(spark, d):
    """A disjoint set of ranges for each file: its keys at a coarse level, each a range of one."""
    return points(spark, d).select(F.col("file_id").alias("qid"), F.shiftright("k", 14).alias("lo")).distinct().withColumn("hi", F.col("lo"))


_MERGED = "WITH r AS (SELECT DISTINCT file_id AS qid, k >> 14 AS lo FROM points), g AS (SELECT *, lo - row_number() OVER (PARTITION BY qid ORDER BY lo) AS g FROM r), m AS (SELECT qid, min(lo) AS lo, max(lo) AS hi FROM g GROUP BY qid, g) "


@query(_MERGED + "SELECT qid, lo, hi FROM m")
def win_merge_ranges(spark, d):
    return R.merge_ranges(_runs(spark, d)).select("qid", "lo", "hi")


@query(_MERGED + ", w AS (SELECT *, lead(lo) OVER (PARTITION BY qid ORDER BY lo) - hi AS gap, count(*) OVER (PARTITION BY qid) AS c FROM m), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY gap NULLS LAST, lo) AS o FROM w), x AS (SELECT *, CASE WHEN lag(gap IS NOT NULL AND o <= c - 10) OVER (PARTITION BY qid ORDER BY lo) THEN 0 ELSE 1 END AS new FROM o), y AS (SELECT *, sum(new) OVER (PARTITION BY qid ORDER BY lo) AS run FROM x) SELECT qid, min(lo) AS lo, max(hi) AS hi FROM y GROUP BY qid, run")
def win_cap_ranges(spark, d):
    return R.cap_ranges(R.merge_ranges(_runs(spark, d))).select("qid", "lo", "hi")


_ORDER = "k, uz, gpstime, pid, intensity, red"
_BLOCKS = f"WITH numbered AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS row FROM points), blocks AS (SELECT row // {CAPACITY} AS block_id, count(*) AS n, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM numbered GROUP BY 1) "


@query(_BLOCKS + "SELECT row // 500 AS block_id, ux, uy, uz FROM numbered")
def win_capacity_blocks(spark, d):
    return B.numbered(points(spark, d), tuple(_ORDER.split(", "))).select(F.floor(F.col("row_") / CAPACITY).alias("block_id"), *XYZ)


@query(_BLOCKS + "SELECT * FROM blocks")
def layout_blocks_capacity(spark, d):
    return _capacity(spark, d).drop("pts")


def _capacity(spark, d):
    return stored.capacity_blocks(spark, d)


@query(_CELLS + "SELECT * FROM cells")
def layout_blocks_cell(spark, d):
    """The stored blocks, read back without their points; a crowded cell is several blocks."""
    ends = [f(c).alias(c) for f, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))]
    return _cells(spark, d).groupBy("cell").agg(F.sum("n").alias("n"), *ends)


# --- Morton ranges -------------------------------------------------------------------------------

#: A cloud far from its offset, as national grids are: raw coordinates need 26 bits.
FAR = (8_500_000, 44_600_000)


def _leaf(sx=0, sy=0):
    """Domain, raw boxes (grown by a unit), areas, level, leaf cells, merged and capped ranges of the catalogue's
    regions, with raw coordinates shifted by (sx, sy). A polygon's leaf counts if an edge passes through its inside
    or its centre is inside."""
    return f"""WITH dom AS (SELECT min(ux) + {sx} AS a, min(uy) + {sy} AS b, max(ux) + {sx} AS c, max(uy) + {sy} AS e FROM points),
dm AS (SELECT length(bin(greatest(c, e))) AS bits, length(bin(greatest(c, e))) - greatest(length(bin(xor(a, c))), length(bin(xor(b, e)))) AS first, greatest(c - a, 1)::DOUBLE * greatest(e - b, 1)::DOUBLE AS cloud FROM dom),
ring AS (SELECT qid, ring, abs(sum(x0*100 * y1*100 - x1*100 * y0*100)) / 2 AS a FROM edges SEMI JOIN (SELECT qid FROM catalogue WHERE type = 'generic') USING (qid) GROUP BY qid, ring),
poly AS (SELECT qid, sum(CASE WHEN ring = 0 THEN a ELSE -a END) AS area FROM ring GROUP BY qid),
raw AS (SELECT b.qid, b.type, CAST(round(minx * 100) AS BIGINT) + {sx} AS x0_, CAST(round(miny * 100) AS BIGINT) + {sy} AS y0_, CAST(round(maxx * 100) AS BIGINT) + 1 + {sx} AS x1_, CAST(round(maxy * 100) AS BIGINT) + 1 + {sy} AS y1_, poly.area FROM boxes b LEFT JOIN poly USING (qid) WHERE type <> 'nn'),
lev AS (SELECT *, CAST(least(greatest(ceil(log2(cloud / greatest(coalesce(area, CAST((x1_-x0_)*(y1_-y0_) AS DOUBLE)), 1.0)) / 2), 1) + first, bits - 1) AS INT) AS level FROM raw, dm),
siz AS (SELECT *, CAST(1 AS BIGINT) << CAST(bits - level - 1 AS INT) AS size FROM lev),
cx AS (SELECT *, unnest(range(x0_ // size, (x1_ - 1) // size + 1)) AS cx FROM siz),
every AS (SELECT *, {sql_encode('cx', 'cy')} AS code FROM (SELECT *, unnest(range(y0_ // size, (y1_ - 1) // size + 1)) AS cy FROM cx)),
part AS (SELECT v.qid, v.code, cx * size AS bx, cy * size AS bz, size, x0*100 + {sx} AS x0, y0*100 + {sy} AS y0, (x1-x0)*100 AS dx, (y1-y0)*100 AS dy FROM every v JOIN edges e ON v.qid = e.qid AND v.type = 'generic'),
clip AS (SELECT *, CASE WHEN dx = 0 THEN CASE WHEN x0 > bx AND x0 < bx + size THEN 0 ELSE 2 END ELSE least((bx-x0)/dx, (bx+size-x0)/dx) END AS xl, CASE WHEN dx = 0 THEN 1 ELSE greatest((bx-x0)/dx, (bx+size-x0)/dx) END AS xh,
  CASE WHEN dy = 0 THEN CASE WHEN y0 > bz AND y0 < bz + size THEN 0 ELSE 2 END ELSE least((bz-y0)/dy, (bz+size-y0)/dy) END AS yl, CASE WHEN dy = 0 THEN 1 ELSE greatest((bz-y0)/dy, (bz+size-y0)/dy) END AS yh, bx + size / 2.0 AS px, bz + size / 2.0 AS py FROM part),
rel AS (SELECT qid, code, bool_or(greatest(0, xl, yl) < least(1, xh, yh)) AS crossed, sum(CASE WHEN (y0 <= py AND y0 + dy > py AND dx * (py - y0) - (px - x0) * dy > 0) OR (y0 > py AND y0 + dy <= py AND dx * (py - y0) - (px - x0) * dy < 0) THEN 1 ELSE 0 END) % 2 = 1 AS odd FROM clip GROUP BY qid, code),
leaf AS (SELECT v.qid, v.code, v.size FROM every v LEFT JOIN rel USING (qid, code) WHERE v.type <> 'generic' OR crossed OR odd),
lr AS (SELECT qid, code*size*size AS lo, (code+1)*size*size-1 AS hi FROM leaf),
new AS (SELECT *, CASE WHEN lo = lag(hi) OVER (PARTITION BY qid ORDER BY lo) + 1 THEN 0 ELSE 1 END AS new FROM lr),
run AS (SELECT *, sum(new) OVER (PARTITION BY qid ORDER BY lo) AS run FROM new),
merged AS (SELECT qid, min(lo) AS lo, max(hi) AS hi FROM run GROUP BY qid, run),
gap AS (SELECT *, lead(lo) OVER (PARTITION BY qid ORDER BY lo) - hi AS gap, count(*) OVER (PARTITION BY qid) AS c FROM merged),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY gap NULLS LAST, lo) AS o FROM gap),
x AS (SELECT *, CASE WHEN lag(gap IS NOT NULL AND o <= c - 10) OVER (PARTITION BY qid ORDER BY lo) THEN 0 ELSE 1 END AS n2 FROM o),
y AS (SELECT *, sum(n2) OVER (PARTITION BY qid ORDER BY lo) AS r2 FROM x),
capped AS (SELECT qid, min(lo) AS lo, max(hi) AS hi FROM y GROUP BY qid, r2) """


_LEAF, _FAR_LEAF = _leaf(), _leaf(*FAR)


def _boxes(spark, d):
    return P.boxes(catalogue(spark, d).filter("type <> 'nn'"))


def _leveled(spark, d, domain):
    return R.auto_level(R.regions(_boxes(spark, d), domain), domain)


@query(_LEAF + "SELECT qid, size, code FROM leaf")
def quadtree_cells(spark, d):
    """The cells of every region, given as the leaves below them: tests hold levels, the full flag and the
    collapse to parents against a brute-force version."""
    domain = stored.domain(spark, d)
    r = _leveled(spark, d, domain)
    cells = R.quadtree(r, domain).join(r.select("qid", F.col("level").alias("deepest")), "qid")
    leaves = F.expr("sequence(shiftleft(code, 2 * (deepest + 1 - level)), shiftleft(code + 1, 2 * (deepest + 1 - level)) - 1)")
    return cells.select("qid", F.expr(f"shiftleft(1L, {domain.bits} - deepest - 1)").alias("size"), F.explode(leaves).alias("code"))


@query(_LEAF + "SELECT qid, level FROM lev")
def quadtree_auto_level(spark, d):
    return _leveled(spark, d, stored.domain(spark, d)).select("qid", "level")


@query(_LEAF + "SELECT qid, lo, hi FROM capped")
def morton_ranges(spark, d):
    return R.asked_by(*R.catalogue_ranges(_boxes(spark, d), stored.domain(spark, d))).select("qid", "lo", "hi")


@query(_FAR_LEAF + "SELECT qid, lo, hi FROM capped")
def morton_ranges_far(spark, d):
    """As :func:`morton_ranges`, over a cloud far from its offset."""
    return R.asked_by(*R.catalogue_ranges(_boxes(spark, d), _far_domain(spark, d))).select("qid", "lo", "hi")


@query(_LEAF + "SELECT qid, lo, hi FROM capped")
def udtf_morton_ranges(spark, d):
    """The session's table function on a column of texts, one call for each different region, dealt to all tasks; boxes
    are grown by a unit."""
    R.register(spark)
    domain = stored.domain(spark, d)
    high = {c: F.col(c) + domain.scale for c in ("maxx", "maxy")}
    q = _boxes(spark, d).withColumns(high)
    corners = [("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny")]
    box = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", *c) for c in corners]), F.lit("))"))
    different, queries = P.once(q.select("qid", F.when(F.col("type") == "generic", F.col("wkt")).otherwise(box).alias("wkt")))
    dealt(different).createOrReplaceTempView("range_regions")
    at = f"{domain.minx}L, {domain.miny}L, {domain.maxx}L, {domain.maxy}L, {domain.scale}D, {domain.offsetx}L, {domain.offsety}L"
    found = spark.sql(f"SELECT rid, lo, hi FROM range_regions, LATERAL morton_ranges(wkt, {at}, CAST(NULL AS INT), {R.MAX_RANGES})")
    return P.asked(found, queries).select("qid", "lo", "hi")


@query(_LEAF + "SELECT m.qid, p.ux, p.uy, p.uz FROM points p JOIN capped m ON p.k BETWEEN m.lo AND m.hi")
def join_morton_ranges(spark, d):
    r, queries = R.catalogue_ranges(_boxes(spark, d), stored.domain(spark, d))
    return R.asked_by(R.join_ranges(stored.clustered(spark, d), r), queries).select("qid", *XYZ)


def _far_domain(spark, d):
    m = stored.domain(spark, d)
    return R.Domain(m.minx + FAR[0], m.miny + FAR[1], m.maxx + FAR[0], m.maxy + FAR[1], m.scale, -FAR[0], -FAR[1])


@query(_FAR_LEAF + f"SELECT m.qid, p.ux, p.uy FROM points p JOIN capped m ON {sql_encode(f'ux + {FAR[0]}', f'uy + {FAR[1]}')} BETWEEN m.lo AND m.hi")
def join_morton_ranges_far(spark, d):
    """As :func:`join_morton_ranges`, over a cloud far from its offset."""
    p = points(spark, d).select("ux", "uy", M.morton_encode(F.col("ux") + FAR[0], F.col("uy") + FAR[1]).alias("k"))
    r, queries = R.catalogue_ranges(_boxes(spark, d), _far_domain(spark, d))
    return R.points_asked_by(R.join_ranges(p, r).select("qid", "ux", "uy"), queries).select("qid", "ux", "uy")


def _region(spark, box, wkt=None):
    minx, miny, maxx, maxy = box
    polygon = f", 'generic' AS type, '{wkt}' AS wkt" if wkt else ""
    return spark.sql(f"SELECT 'q' AS qid, {minx}D AS minx, {miny}D AS miny, {maxx}D AS maxx, {maxy}D AS maxy{polygon}")


def _through_ranges(spark, d, box, wkt=None):
    """Candidates of one region (its polygon, if there is one) by its ranges, pushed to the scan of the
    clustered table as a few literals."""
    found = R.morton_ranges(_region(spark, box, wkt), stored.domain(spark, d)).collect()  # ten at most
    return stored.clustered(spark, d).filter(in_ranges(F.col("k"), [(r.lo, r.hi) for r in found]))


@query(f"SELECT ux, uy, uz FROM points WHERE {_RECT}")
def q_morton_rectangle(spark, d):
    return P.select_rect(_through_ranges(spark, d, S_RECT), S_RECT).select(*XYZ)


@query("SELECT ux, uy, uz FROM points WHERE x BETWEEN 480 AND 520 AND y BETWEEN 480 AND 520 AND (x-500)*(x-500)+(y-500)*(y-500) < 400")
def q_morton_circle(spark, d):
    return P.select_circle(_through_ranges(spark, d, (480.0, 480.0, 520.0, 520.0)), *S_CIRC).select(*XYZ)


@query("SELECT ux, uy, uz, (x-500)*(x-500)+(y-500)*(y-500) AS d2 FROM points WHERE x BETWEEN 400 AND 600 AND y BETWEEN 400 AND 600 ORDER BY d2, ux, uy, uz LIMIT 1000")
def q_morton_nn(spark, d):
    return P.select_nn(_through_ranges(spark, d, (400.0, 400.0, 600.0, 600.0)), 500, 500, 100, 1000).select(*XYZ, "d2")


@query(_poly_sql(HOLED))
def q_morton_polygon(spark, d):
    return P.select_polygon(_through_ranges(spark, d, P.box_of(HOLED), HOLED), HOLED).select(*XYZ)


#: Full ranges, the longest first, that are told apart in the filter; points of others are refined.
FULL_RANGES = 32


@query(_poly_sql(HOLED))
def q_morton_split(spark, d):
    """One pass: the region's ranges are pushed to the scan, and only points outside its full ranges are tested
    against the polygon."""
    domain, region = stored.domain(spark, d), _region(spark, P.box_of(HOLED), HOLED)
    r = staged(R.morton_ranges(region, domain, split_full=True), "split")
    every = R.cap_ranges(R.merge_ranges(r.drop("full"))).collect()  # ten at most
    full = r.filter("full").orderBy(F.col("hi") - F.col("lo"), ascending=False).limit(FULL_RANGES).collect()
    near = stored.clustered(spark, d).filter(in_ranges(F.col("k"), [(x.lo, x.hi) for x in every]))
    whole = in_ranges(F.col("k"), [(x.lo, x.hi) for x in full])
    return near.filter(whole | inside(literal_edges(HOLED), F.col("x"), F.col("y"))).select(*XYZ)


# --- blocks --------------------------------------------------------------------------------------


@query(_BLOCKS + "SELECT block_id FROM blocks WHERE minx <= 451 AND maxx >= 400 AND miny <= 453 AND maxy >= 400")
def filter_blocks(spark, d):
    return B.filter_blocks(_capacity(spark, d), *S_RECT).select("block_id")


@query("SELECT ux, uy, uz FROM points")
def explode_blocks(spark, d):
    return B.explode_blocks(_cells(spark, d)).select(*XYZ)


@query(f"SELECT ux, uy, uz FROM points WHERE {_RECT}")
def clip_blocks(spark, d):
    return B.clip_blocks(_cells(spark, d), *S_RECT).select(*XYZ)


@query(f"SELECT ux, uy, uz FROM points WHERE {_LRECT} AND z <= 10")
def q_blocks_rectangle(spark, d):
    return B.clip_blocks(_capacity(spark, d), *L_RECT).filter("z <= 10").select(*XYZ)


@query("SELECT ux, uy, uz FROM points WHERE x BETWEEN 480 AND 520 AND y BETWEEN 480 AND 520 AND (x-500)*(x-500)+(y-500)*(y-500) < 400")
def q_blocks_circle(spark, d):
    return P.select_circle(B.clip_blocks(_capacity(spark, d), 480.0, 480.0, 520.0, 520.0), *S_CIRC).select(*XYZ)


@query(_poly_sql(HOLED))
def q_blocks_polygon(spark, d):
    return P.select_polygon(B.clip_blocks(_capacity(spark, d), *P.box_of(HOLED)), HOLED).select(*XYZ)


@query("SELECT q.qid, count(*) AS n FROM points p JOIN boxes q ON q.type = 'rectangle' AND p.x BETWEEN q.minx AND q.maxx AND p.y BETWEEN q.miny AND q.maxy GROUP BY q.qid")
def join_blocks_query(spark, d):
    """Blocks meet query boxes by grid cells, points are clipped after that."""
    b = _capacity(spark, d)
    cells = lambda a, c: F.explode(F.sequence(F.floor(F.col(a) / P.CELL), F.floor(F.col(c) / P.CELL)))
    left = b.withColumn("gx", cells("minx", "maxx")).withColumn("gy", cells("miny", "maxy")).select("block_id", "gx", "gy")
    q = P.boxes(catalogue(spark, d).filter("type = 'rectangle'")).select("qid", *[F.col(c).alias(f"q{c}") for c in ("minx", "miny", "maxx", "maxy")])
    right = q.withColumn("gx", cells("qminx", "qmaxx")).withColumn("gy", cells("qminy", "qmaxy"))
    met = left.join(right, ["gx", "gy"]).drop("gx", "gy").distinct()
    pts = b.select("block_id", "pts").join(met, "block_id").select("qid", "qminx", "qminy", "qmaxx", "qmaxy", F.inline("pts"))
    return pts.filter("x between qminx and qmaxx and y between qminy and qmaxy").groupBy("qid").agg(F.count("*").alias("n"))


@query(_BLOCKS + f", c AS (SELECT block_id FROM blocks WHERE minx <= 451 AND maxx >= 400 AND miny <= 453 AND maxy >= 400) SELECT ux, uy, uz FROM numbered WHERE row // {CAPACITY} IN (SELECT block_id FROM c)")
def join_candidate_ids(spark, d):
    """Two phases: ids of candidate blocks, then the points of those blocks."""
    b = _capacity(spark, d)
    ids = staged(B.filter_blocks(b, *S_RECT).select("block_id"), "candidates")
    return B.explode_blocks(b.join(bounded(ids), "block_id", "left_semi")).select(*XYZ)


@query(_BLOCKS + f", near AS (SELECT block_id FROM (SELECT *, greatest(minx-500, 500-maxx, 0)*greatest(minx-500, 500-maxx, 0) + greatest(miny-500, 500-maxy, 0)*greatest(miny-500, 500-maxy, 0) AS dd FROM blocks) ORDER BY dd, minx, miny LIMIT 9) SELECT ux, uy, uz, (x-500)*(x-500)+(y-500)*(y-500) AS d2 FROM numbered WHERE row // {CAPACITY} IN (SELECT block_id FROM near) ORDER BY d2, ux, uy, uz LIMIT 100")
def nn_blocks(spark, d):
    return B.nn_blocks(_capacity(spark, d), 500.0, 500.0, 100, CAPACITY).select(*XYZ, "d2")

