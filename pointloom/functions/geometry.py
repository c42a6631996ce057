"""Geometry text and predicates as DataFrame expressions."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def _numbers(wkt: Column) -> Column:
    return F.transform(F.regexp_extract_all(wkt, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))


def with_bbox(q: DataFrame) -> DataFrame:
    """Adds minx, miny, maxx, maxy over all vertices, holes included."""
    n = _numbers(F.col("wkt"))
    x, y = F.filter(n, lambda v, i: i % 2 == 0), F.filter(n, lambda v, i: i % 2 == 1)
    return q.withColumns({"minx": F.array_min(x), "miny": F.array_min(y), "maxx": F.array_max(x), "maxy": F.array_max(y)})


def with_circle(q: DataFrame) -> DataFrame:
    """Adds cx, cy, rad of the box: its centre and half its x width."""
    b = with_bbox(q)
    return b.withColumns({"cx": (F.col("minx") + F.col("maxx")) / 2, "cy": (F.col("miny") + F.col("maxy")) / 2, "rad": (F.col("maxx") - F.col("minx")) / 2})


def with_point(q: DataFrame) -> DataFrame:
    n = _numbers(F.col("wkt"))
    return q.withColumns({"px": F.element_at(n, 1), "py": F.element_at(n, 2)})


def edges(q: DataFrame) -> DataFrame:
    """``(qid, ring, edge, x0, y0, x1, y1)`` of every polygon ring, outer ring first."""
    body = F.regexp_extract("wkt", r"\(\((.*)\)\)", 1)
    rings = q.select("qid", F.posexplode(F.split(body, r"\)\s*,\s*\(")).alias("ring", "text"))
    points = F.transform(F.split(F.trim("text"), r"\s*,\s*"), lambda v: F.transform(F.split(F.trim(v), r"\s+"), lambda t: t.cast("double")))
    rings = rings.select("qid", "ring", points.alias("p"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.element_at("p", i).alias("a"), F.element_at("p", i + 1).alias("b")))
    out = rings.select("qid", "ring", F.posexplode(pairs).alias("edge", "e"))
    return out.select("qid", "ring", "edge", F.col("e.a")[0].alias("x0"), F.col("e.a")[1].alias("y0"), F.col("e.b")[0].alias("x1"), F.col("e.b")[1].alias("y1"))


def edge_array(wkt: Column) -> Column:
    """All edges of a polygon text, rings in turn, as ``array<struct<x0,y0,x1,y1>>``."""
    rings = F.split(F.regexp_extract(wkt, r"\(\((.*)\)\)", 1), r"\)\s*,\s*\(")
    points = F.transform(rings, lambda r: F.transform(F.split(F.trim(r), r"\s*,\s*"), lambda v: F.transform(F.split(F.trim(v), r"\s+"), lambda t: t.cast("double"))))
    edge = lambda a, b: F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1"))
    return F.flatten(F.transform(points, lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), edge)))


def rings_of(wkt: str) -> list[list[tuple[float, float]]]:
    """The rings of one polygon text, for a query given as a literal."""
    body = wkt[wkt.index("((") + 2 : wkt.rindex("))")]
    return [[tuple(map(float, v.split())) for v in r.split(",")] for r in re.split(r"\)\s*,\s*\(", body)]


def literal_edges(wkt: str) -> Column:
    edges_ = [(*a, *b) for r in rings_of(wkt) for a, b in zip(r, r[1:])]
    return F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), e)]) for e in edges_])


def inside(edges_: Column, px: Column, py: Column) -> Column:
    """Whether a point lies in a polygon: an odd number of crossings over its edges, holes included."""
    return F.aggregate(edges_, F.lit(0), lambda n, e: n + crossing(px, py, e)) % 2 == 1


def scaled(e: DataFrame, scale: float, offset: int = 0) -> DataFrame:
    """Edges in raw integers, truncated towards zero."""
    return e.select("qid", "ring", "edge", *[(F.col(c) / scale - offset).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


def dist2(x: Column, y: Column, cx, cy) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy)


def bbox(x: Column, y: Column, minx, miny, maxx, maxy) -> Column:
    return x.between(minx, maxx) & y.between(miny, maxy)


def z_range(z: Column, low=None, high=None) -> Column:
    """Either bound may be absent."""
    out = F.lit(True)
    if low is not None:
        out = out & (z >= low)
    if high is not None:
        out = out & (z <= high)
    return out


def circle_box(x: Column, y: Column, cx, cy, rad) -> Column:
    return bbox(x, y, cx - rad, cy - rad, cx + rad, cy + rad)


def circle(x: Column, y: Column, cx, cy, rad) -> Column:
    return circle_box(x, y, cx, cy, rad) & (dist2(x, y, cx, cy) < rad * rad)


def in_ranges(k: Column, ranges: list[tuple[int, int]]) -> Column:
    """OR of closed ranges: a handful of literals that reach the Parquet scan."""
    out = F.lit(False)
    for low, high in ranges:
        out = out | k.between(low, high)
    return out


def crossing(px: Column, py: Column, e: Column) -> Column:
    """1 if the ray from the point crosses edge (x0, y0)-(x1, y1), half open in y."""
    side = (e.x1 - e.x0) * (py - e.y0) - (px - e.x0) * (e.y1 - e.y0)
    up, down = (e.y0 <= py) & (e.y1 > py), (e.y0 > py) & (e.y1 <= py)
    return F.when((up & (side > 0)) | (down & (side < 0)), 1).otherwise(0)


def contains_udf(rings: list[list[tuple[float, float]]]):
    """Vectorised alternative to the edge join for one polygon (holes after the outer ring)."""
    parts = [np.array(r, float) for r in rings]

    @F.pandas_udf("boolean")
    def inside(x, y):
        px, py = x.to_numpy(float), y.to_numpy(float)
        odd = np.zeros(len(px), bool)
        for ring in parts:
            for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:]):
                side = (x1 - x0) * (py - y0) - (px - x0) * (y1 - y0)
                odd ^= ((y0 <= py) & (y1 > py) & (side > 0)) | ((y0 > py) & (y1 <= py) & (side < 0))
        import pandas as pd

        return pd.Series(odd)

    return inside
