"""Registration of queries with their checking SQL."""

from __future__ import annotations

from ..functions.morton import sql_encode, sql_gather
from ..sources.points import CATALOGUE_SQL, POINTS_SQL

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Common tables of the checking SQL.
CTE = (
    "WITH points AS (" + POINTS_SQL + "), catalogue AS (" + CATALOGUE_SQL.replace("AS STRING", "AS VARCHAR") + "), "
    "files AS (SELECT file_id, count(*) AS num, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, min(z) AS minz, max(z) AS maxz, CASE WHEN count(*) % 3 = 0 THEN 0.001::DOUBLE ELSE 0.01::DOUBLE END AS scale, CAST(floor(min(x)) AS DOUBLE) AS \"offset\" FROM points GROUP BY file_id), "
    "nums AS (SELECT qid, type, wkt, minz AS qminz, maxz AS qmaxz, num, radius, list_transform(regexp_extract_all(wkt, '-?[0-9]+'), lambda v: CAST(v AS DOUBLE)) AS n FROM catalogue), "
    "boxes AS (SELECT *, list_min(list_filter(n, lambda v, i: i % 2 = 1)) AS minx, list_min(list_filter(n, lambda v, i: i % 2 = 0)) AS miny, list_max(list_filter(n, lambda v, i: i % 2 = 1)) AS maxx, list_max(list_filter(n, lambda v, i: i % 2 = 0)) AS maxy FROM nums), "
    "rings AS (SELECT qid, unnest(range(len(r))) AS ring, unnest(r) AS t FROM (SELECT qid, string_split(regexp_extract(wkt, '\\(\\((.*)\\)\\)', 1), '), (') AS r FROM catalogue WHERE type <> 'nn')), "
    "verts AS (SELECT qid, ring, list_transform(string_split(t, ', '), lambda v: list_transform(string_split(v, ' '), lambda w: CAST(w AS DOUBLE))) AS p FROM rings), "
    "edges AS (SELECT qid, ring, i - 1 AS edge, p[i][1] AS x0, p[i][2] AS y0, p[i + 1][1] AS x1, p[i + 1][2] AS y1 FROM (SELECT *, unnest(range(1, len(p))) AS i FROM verts)), "
    "inpoly AS (SELECT b.qid, p.ux, p.uy FROM (SELECT DISTINCT ux, uy, x, y FROM points) p JOIN boxes b ON b.type = 'generic' AND p.x BETWEEN b.minx AND b.maxx AND p.y BETWEEN b.miny AND b.maxy JOIN edges e ON e.qid = b.qid "
    "GROUP BY b.qid, p.ux, p.uy HAVING sum(CASE WHEN (y0 <= p.y AND y1 > p.y AND (x1 - x0) * (p.y - y0) - (p.x - x0) * (y1 - y0) > 0) OR (y0 > p.y AND y1 <= p.y AND (x1 - x0) * (p.y - y0) - (p.x - x0) * (y1 - y0) < 0) THEN 1 ELSE 0 END) % 2 = 1) "
)
__all__ = ["CTE", "ORACLE", "QUERIES", "query", "sql_encode", "sql_gather"]


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame; ``sql`` may use the tables of CTE."""

    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = CTE + (", " + sql.lstrip()[5:] if sql.lstrip().startswith("WITH ") else sql)
        return f

    return keep
