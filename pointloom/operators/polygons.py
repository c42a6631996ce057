"""Selections by region, for one query or a whole catalogue."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import box_cells, first_size, polygon_cells
from ..functions.geometry import circle, crossing, dist2, inside, literal_edges, rings_of, with_bbox, with_point, z_range
from .staging import bounded, dealt, staged

#: Side of the grid cells that blocks and query boxes meet in.
CELL = 32.0
#: Up to so many nearest points a query, Spark ranks within tasks before it shuffles; beyond it, parts of a query do.
GROUP_LIMIT, PARTS = 1000, 64
CELLS = "j int, cx long, cy long, parity int, heights array<double>, edges array<struct<x0:double,y0:double,x1:double,y1:double>>"


def one_of(q: DataFrame, qid: str) -> DataFrame:
    return q.filter(F.col("qid") == qid)


def boxes(q: DataFrame) -> DataFrame:
    """Catalogue with its search box: that of the WKT, or the square around a neighbour query's point."""
    b = with_point(with_bbox(q))
    nn = F.col("type") == "nn"
    for c, v in {"minx": F.col("px") - F.col("radius"), "maxx": F.col("px") + F.col("radius"), "miny": F.col("py") - F.col("radius"), "maxy": F.col("py") + F.col("radius")}.items():
        b = b.withColumn(c, F.when(nn, v).otherwise(F.col(c)))
    return b


def once(q: DataFrame, *own: str) -> tuple[DataFrame, DataFrame]:
    """A catalogue's different regions, with a number ``rid`` each, and ``(rid, qid, *own)`` of the queries that ask for
    them: queries that agree in all columns but ``qid`` and ``own`` are answered once. Both tables are staged."""
    shared = [c for c in q.columns if c not in ("qid", *own)]
    different = staged(dealt(q.groupBy(*shared).agg(F.count("*").alias("_n"))).withColumn("rid", F.monotonically_increasing_id()).drop("_n"), "regions")
    named = different.withColumnsRenamed({c: f"_{c}" for c in shared})
    same = F.lit(True)
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return different, staged(q.join(named, same).select("rid", "qid", *own), "asked")


def asked(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows found for regions, once for each query that asks for the region."""
    return found.join(bounded(queries), "rid").drop("rid")


def asked_in_order(found: DataFrame, queries: DataFrame) -> DataFrame:
    """As :func:`asked`, for points, whose number times that of the queries is returned. Each task's points of the different
    regions are staged in order of region, so that the rows of the product, of which nothing is kept, come as runs
    of equal points and returning ids, which a columnar file holds in a fraction of the bytes."""
    return asked(staged(found.sortWithinPartitions("rid"), "found"), queries)


def decomposed(q: DataFrame) -> DataFrame:
    """Catalogue rows (with their box, without their text) once for each cell of their region: see
    :mod:`..functions.cells`. Cells of boxes and circles hold no edges; rows without a box have no cells. A
    border cell carries what it is tested with, so its size follows the edges inside it."""
    b = boxes(q).withColumnsRenamed({"minz": "qminz", "maxz": "qmaxz"})
    kept = [c for c in b.columns if c != "wkt"]
    names = ("x0", "y0", "x1", "y1")
    point = pa.struct([(c, pa.float64()) for c in names])

    def rows(batch):
        for i, (kind, wkt, *box) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("type", "wkt", "minx", "miny", "maxx", "maxy")))):
            if None in box:
                continue
            if kind == "generic":
                rings = [np.array(r) for r in rings_of(wkt)]
                for cell in polygon_cells(np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for r in rings]), box):
                    yield i, *cell
            else:
                j = first_size(box)
                for cx, cy in zip(*box_cells(box, j)):
                    yield i, j, int(cx), int(cy), 1, (), np.empty((0, 4))

    def out(batch, held):
        at, j, cx, cy, parity, heights, edges = zip(*held)
        flat = np.concatenate(edges)
        ends = np.cumsum([0, *map(len, edges)], dtype=np.int32)
        segments = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], fields=list(point)))
        chosen = batch.select(kept).take(pa.array(at))
        columns = [pa.array(j, pa.int32()), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), pa.array(parity, pa.int32()), pa.array([list(h) for h in heights], pa.list_(pa.float64())), segments]
        return pa.RecordBatch.from_arrays([*chosen.columns, *columns], [*kept, "j", "cx", "cy", "parity", "heights", "edges"])

    def run(batches):
        for batch in batches:
            held = []
            for row in rows(batch):
                held.append(row)
                if len(held) == 4096:
                    yield out(batch, held)
                    held = []
            if held:
                yield out(batch, held)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in b.select(*kept).schema.fields)
    return staged(dealt(b).mapInArrow(run, f"{fields}, {CELLS}"), "region-cells")


def join_cells(p: DataFrame, q: DataFrame) -> DataFrame:
    """Points with every query whose box and heights hold them and whose cell they fall in: an equi-join on cells
    of a few sizes, a point having one cell of each. Regions' cells do not overlap, so each pair appears once.
    Polygons are left to :func:`in_polygons`, which looks at the cell's edges alone."""
    cells = decomposed(q)
    sizes = [r.j for r in cells.select("j").distinct().orderBy("j").collect()]  # a few tens at most
    if not sizes:
        return p.join(cells, F.lit(False)).drop("j", "cx", "cy")
    at = lambda c, j: F.floor(F.col(c) / F.lit(2.0**j)).cast("long")
    keys = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), at("x", j).alias("cx"), at("y", j).alias("cy")) for j in sizes]))
    on = p.withColumn("_c", keys).withColumns({c: F.col(f"_c.{c}") for c in ("j", "cx", "cy")}).drop("_c")
    met = on.join(bounded(cells), ["j", "cx", "cy"]).drop("j", "cx", "cy")
    box = (F.col("type") == "generic") | (F.col("x").between(F.col("minx"), F.col("maxx")) & F.col("y").between(F.col("miny"), F.col("maxy")))
    low, high = F.col("qminz").isNull() | (F.col("z") >= F.col("qminz")), F.col("qmaxz").isNull() | (F.col("z") <= F.col("qmaxz"))
    return met.filter(box & low & high)


def _in_cell() -> Column:
    """Whether a point lies in its cell's part of the polygon, as all edges together would tell."""
    turns = F.size(F.filter("heights", lambda h: h <= F.col("y")))
    return F.aggregate("edges", F.col("parity") + turns, lambda n, e: n + crossing(F.col("x"), F.col("y"), e)) % 2 == 1


def in_polygons(met: DataFrame) -> DataFrame:
    """Of (point, query) pairs those inside the polygon: no join, no shuffle."""
    return met.filter(_in_cell()).drop("parity", "heights", "edges")


def refined(p: DataFrame, q: DataFrame, *kept: str) -> DataFrame:
    """Points of every rectangle, circle and polygon query of the catalogue, with the columns ``kept`` (all, if none is
    named) and ``qid``: of each different region once, then for every query that asks for it."""
    different, queries = once(q.filter("type <> 'nn'"), "num")
    return asked_in_order(refined_regions(p, different).select("rid", *(kept or p.columns)), queries)


def within(p: DataFrame, q: DataFrame, *kept: str) -> DataFrame:
    """Points of every polygon of the catalogue: the step of :func:`refined` for polygons alone."""
    different, queries = once(q.filter("type = 'generic'"), "num")
    return asked_in_order(in_polygons(join_cells(p, different)).select("rid", *(kept or p.columns)), queries)


def summaries(p: DataFrame, q: DataFrame, *aggregates: Column) -> DataFrame:
    """``(qid, *aggregates)`` of every query but neighbour searches; nulls where no point lies inside. Points are
    aggregated by region, so the rows that meet do not follow the number of queries that ask for the same."""
    different, queries = once(q.filter("type <> 'nn'"), "num")
    return queries.join(refined_regions(p, different).groupBy("rid").agg(*aggregates), "rid", "left").drop("rid")


def refined_regions(p: DataFrame, q: DataFrame) -> DataFrame:
    """Points of every rectangle, circle and polygon of ``q``."""
    met = join_cells(p, q)
    cx, cy, rad = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2, (F.col("maxx") - F.col("minx")) / 2
    disc = dist2(F.col("x"), F.col("y"), cx, cy) < rad * rad
    kept = F.when(F.col("type") == "generic", _in_cell()).when(F.col("type") == "circle", disc).otherwise(F.col("type") == "rectangle")
    return met.filter(kept).drop("parity", "heights", "edges")


def nearest(p: DataFrame, q: DataFrame) -> DataFrame:
    """The ``num`` nearest points in the square around every neighbour query's point. Ties go by raw
    coordinates. Queries that differ in ``num`` alone are ranked once. No more than the largest ``num`` of a task's
    candidates of a region are shuffled; where that is over GROUP_LIMIT, a region's candidates are dealt to PARTS first
    and each part is ranked."""
    different, queries = once(q.filter("type = 'nn'"), "num")
    most = queries.agg(F.max("num")).first()[0] or 0
    largest = queries.groupBy("rid").agg(F.max("num").alias("_most"))
    met = join_cells(p, different.join(largest, "rid")).drop("parity", "heights", "edges").withColumn("d2", dist2(F.col("x"), F.col("y"), F.col("px"), F.col("py")))
    order = ["d2", "ux", "uy", "uz"]
    if most > GROUP_LIMIT:
        part = Window.partitionBy("rid", F.pmod(F.xxhash64("ux", "uy", "uz"), F.lit(PARTS))).orderBy(*order)
        met = met.withColumn("_place", F.row_number().over(part)).filter(F.col("_place") <= F.col("_most")).drop("_place")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy(*order)))
    ranked = ranked.filter(F.col("rank") <= F.lit(most)).filter("rank <= _most").drop("_most")
    return asked(ranked, queries).filter("rank <= num")


def select_rect(p: DataFrame, region, low=None, high=None) -> DataFrame:
    minx, miny, maxx, maxy = region
    return p.filter(F.col("x").between(minx, maxx) & F.col("y").between(miny, maxy) & z_range(F.col("z"), low, high))


def select_circle(p: DataFrame, cx, cy, rad, low=None, high=None) -> DataFrame:
    return p.filter(circle(F.col("x"), F.col("y"), cx, cy, rad) & z_range(F.col("z"), low, high))


def box_of(wkt: str) -> tuple[float, float, float, float]:
    x, y = zip(*(v for r in rings_of(wkt) for v in r))
    return min(x), min(y), max(x), max(y)


def select_polygon(p: DataFrame, wkt: str, low=None, high=None) -> DataFrame:
    """Points of one polygon given as text: box first, then crossings over its edges, a constant array."""
    return select_rect(p, box_of(wkt), low, high).filter(inside(literal_edges(wkt), F.col("x"), F.col("y")))


def select_nn(p: DataFrame, cx, cy, radius, num, low=None, high=None) -> DataFrame:
    near = select_rect(p, (cx - radius, cy - radius, cx + radius, cy + radius), low, high)
    return near.withColumn("d2", dist2(F.col("x"), F.col("y"), F.lit(cx), F.lit(cy))).orderBy("d2", "ux", "uy", "uz").limit(num)


def tiles(n: int, low: float, high: float, c: Column) -> Column:
    """Index of n equal tiles; the upper edge counts to the last."""
    return F.least(F.floor((c - low) * n / (high - low)), F.lit(n - 1)).cast("int")

