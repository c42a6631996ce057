"""Properties of keys and ranges, equality of layouts, and sources."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pointloom.functions import morton as M
from pointloom.operators import blocks as B
from pointloom.operators import polygons as P
from pointloom.operators import ranges as R
from pointloom.plans import registry
from pointloom.sources import las, text
from pointloom.sources.points import catalogue, dims, points

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_morton_round_trip(spark):
    r = random.Random(1)
    pairs = [(r.randrange(2**31), r.randrange(2**31)) for _ in range(300)] + [(0, 0), (2**31 - 1, 2**31 - 1), (2**31 - 1, 0)]
    k = M.morton_encode(F.col("x"), F.col("y"))
    got = spark.createDataFrame(pairs, "x long, y long").select("x", "y", k.alias("k"), M.morton_x(k).alias("mx"), M.morton_y(k).alias("my")).collect()
    for g in got:
        assert (g.mx, g.my) == (g.x, g.y)
        assert g.k == sum((g.x >> i & 1) << (2 * i + 1) | (g.y >> i & 1) << (2 * i) for i in range(31))


@pytest.mark.parametrize("group", [["q_rectangle", "q_morton_rectangle", "filter_bbox", "clip_blocks"], ["q_circle", "q_morton_circle", "q_blocks_circle"], ["q_polygon", "q_morton_polygon", "q_blocks_polygon", "udf_contains"], ["q_nn", "q_morton_nn"]])
def test_layouts_agree(spark, group):
    found = [rows(registry.QUERIES[n](spark, SF).select("ux", "uy", "uz")) for n in group]
    assert all(f == found[0] for f in found) and found[0]


def test_ranges(spark):
    b = P.boxes(catalogue(spark, SF).filter("type <> 'nn'"))
    domain = R.domain_of(points(spark, SF))
    merged, capped = R.morton_ranges(b, domain, max_ranges=None).collect(), R.morton_ranges(b, domain).collect()
    for qid in {r.qid for r in merged}:
        m, c = (sorted((r.lo, r.hi) for r in s if r.qid == qid) for s in (merged, capped))
        assert all(a[1] + 1 < z[0] for a, z in zip(m, m[1:])) and len(c) <= 10
        assert all(any(lo <= a and z <= hi for lo, hi in c) for a, z in m)


def test_cap_keeps_the_largest_gaps(spark):
    r = random.Random(4)
    for _ in range(5):
        ends = sorted(r.sample(range(200), 30))
        cover = [(ends[i], ends[i + 1]) for i in range(0, 30, 2)]
        merged = [list(x) for x in cover]
        while len(merged) > 4:  # the plain rule: close the smallest gap, the earliest of equal ones
            gaps = [merged[i + 1][0] - merged[i][1] for i in range(len(merged) - 1)]
            i = gaps.index(min(gaps))
            merged[i : i + 2] = [[merged[i][0], merged[i + 1][1]]]
        got = R.cap_ranges(spark.createDataFrame([("q", a, b) for a, b in cover], "qid string, lo long, hi long"), 4)
        assert rows(got.select("lo", "hi")) == [tuple(x) for x in merged]


def test_repeated_points_survive_polygons(spark):
    p = points(spark, SF)
    twice = p.unionByName(p)
    q = catalogue(spark, SF)
    assert P.refined(twice, q).count() == 2 * P.refined(p, q).count() > 0


def test_unknown_letter():
    with pytest.raises(ValueError):
        dims("xq")


def test_las(spark, tmp_path):
    p = points(spark, SF).filter("file_id < 3")
    made = las.write_las(p, str(tmp_path)).collect()
    (tmp_path / "list").write_text("\n".join(r.path for r in made))
    assert sum(r.num for r in made) == p.count()
    assert las.read_las(spark, f"@{tmp_path}/list", "XYZ").count() == p.count()
    assert rows(las.read_las(spark, str(tmp_path / "*.las"), "XYZirR").drop("path", "m")) == rows(p.select("ux", "uy", "uz", "intensity", (F.col("returnnum").cast("int").bitwiseAND(F.lit(7))).cast("short"), "red"))
    (tmp_path / "bad.txt").write_text("no header")
    newer = bytearray((tmp_path / made[0].path.rpartition("/")[2]).read_bytes())
    newer[104] = 6
    (tmp_path / "new.laz").write_bytes(bytes(newer))
    with pytest.raises(Exception, match="format 6"):
        las.read_headers(spark, str(tmp_path / "new.laz")).collect()
    with pytest.raises(Exception, match="no LAS file"):
        las.read_headers(spark, str(tmp_path / "bad.txt")).collect()


def test_catalogue_ids_are_unique(spark, tmp_path):
    one = '<query id="01" key="A"><type>rectangle+z</type><wkt> POLYGON ((0 0, 1 0, 1 1, 0 0)) </wkt><minz></minz><maxz>-1</maxz></query>'
    (tmp_path / "a.xml").write_text(f"<queries>{one}</queries>")
    got = text.read_queries(spark, str(tmp_path)).first()
    assert (got.qid, got.minz, got.maxz) == ("01", None, -1.0)
    (tmp_path / "b.xml").write_text(f"<queries>{one}</queries>")
    with pytest.raises(ValueError):
        text.read_queries(spark, str(tmp_path))


def test_bad_text_fails(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1,2\nx,3\n")
    with pytest.raises(Exception):
        text.read_points(spark, str(tmp_path), "XY").collect()


def brute_cells(wkt, bits, deepest):
    """Cells of integer coordinates straight from the rule, leaf by leaf, on polygons whose edges are known."""
    from pointloom.functions.geometry import rings_of

    edges = [(*a, *b) for r in rings_of(wkt) for a, b in zip(r, r[1:])]

    def inside(px, py):
        n = 0
        for x0, y0, x1, y1 in edges:
            side = (x1 - x0) * (py - y0) - (px - x0) * (y1 - y0)
            n += (y0 <= py < y1 and side > 0) or (y1 <= py < y0 and side < 0)
        return n % 2 == 1

    def state(level, cx, cy):
        """0: apart, 1: inside, 2: partly, by a fine raster of the open cell."""
        size = 1 << bits - level
        steps = 24
        got = {inside(cx * size + size * (i + 0.5) / steps, cy * size + size * (j + 0.5) / steps) for i in range(steps) for j in range(steps)}
        return 0 if got == {False} else 1 if got == {True} else 2

    def walk(level, cx, cy):
        out = []
        count = 0
        for q in range(4):
            x, y = 2 * cx + (q >> 1), 2 * cy + (q & 1)
            s = state(level + 1, x, y)
            code = sum((x >> i & 1) << 2 * i + 1 | (y >> i & 1) << 2 * i for i in range(bits))
            if s == 1 or s == 2 and level + 1 == deepest:
                out.append((level + 1, code, s == 1))
                count += 1
            elif s == 2:
                below, n = walk(level + 1, x, y)
                if n == 4:
                    out.append((level + 1, code, False))
                    count += 1
                else:
                    out += below
        return out, count

    return sorted(walk(0, 0, 0)[0])


@pytest.mark.parametrize("wkt", ["POLYGON ((2 2, 30 2, 30 30, 2 30, 2 2))", "POLYGON ((1 1, 61 49, 61 53, 1 5, 1 1))", "POLYGON ((0 0, 64 0, 64 64, 0 64, 0 0), (16 16, 40 16, 40 40, 16 40, 16 16))", "POLYGON ((32 4, 60 32, 32 60, 4 32, 32 4))"])
def test_quadtree_of_polygons(wkt):
    from pointloom.functions.geometry import rings_of
    from pointloom.functions.quadtree import cells_of

    edges = [(*a, *b) for r in rings_of(wkt) for a, b in zip(r, r[1:])]
    assert sorted(zip(*(c.tolist() for c in cells_of(edges, 6, 5)))) == brute_cells(wkt, 6, 5)


def test_ranges_of_a_diagonal_follow_it(spark):
    """A narrow diagonal strip: the ranges hold a small part of its box."""
    from pointloom.plans.selections import DIAG

    box = dict(zip(("minx", "miny", "maxx", "maxy"), P.box_of(DIAG)))
    q = spark.createDataFrame([("q", "generic", DIAG, *box.values())], "qid string, type string, wkt string, minx double, miny double, maxx double, maxy double")
    size = lambda df: sum(r.hi - r.lo + 1 for r in df.collect())
    domain = R.Domain(0, 0, 99_999, 99_999)
    assert size(R.morton_ranges(q, domain, max_ranges=None)) < 0.2 * size(R.morton_ranges(q.drop("wkt", "type"), domain, max_ranges=None))


@pytest.mark.parametrize("name", ["filter_morton_ranges", "q_morton_rectangle", "q_morton_polygon", "layout_morton"])
def test_ranges_reach_the_scan(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed = [x for x in plan.split("PushedFilters: [")[1:]]
    assert any("GreaterThanOrEqual(k," in x.split("]")[0] for x in pushed)
    assert "NestedLoop" not in plan


def test_numbers_within_groups(spark):
    from pointloom.operators import blocks as B

    r = random.Random(2)
    data = [(r.randrange(3), r.randrange(1000)) for _ in range(500)]
    got = B.numbered_within(spark.createDataFrame(data, "g int, v int"), "g", ("v",)).collect()
    for g in range(3):
        mine = sorted((x.row, x.v, x.of) for x in got if x.g == g)
        assert [x[0] for x in mine] == list(range(len(mine))) and [x[1] for x in mine] == sorted(v for h, v in data if h == g)
        assert all(x[2] == len(mine) for x in mine)


def test_cell_blocks_keep_points_without_a_key(spark):
    p = points(spark, SF).limit(100).withColumn("k", F.when(F.col("uz") > 2500, F.col("k")))
    assert 0 < p.filter("k is null").count() < 100
    b = B.blocks_by_cell(p, level=5, capacity=20).collect()
    assert sum(r.n for r in b) == 100 and max(r.n for r in b) < 60
    assert sum(r.n for r in b if r.cell is None) == p.filter("k is null").count()


def test_a_key_in_a_filter_stays_compilable(spark, capsys):
    """The JVM leaves methods of more than 8,000 bytes of code uncompiled."""
    points(spark, SF).filter("k is not null").select("ux").explain(mode="codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_capacity_blocks_carry_their_columns_only(spark, monkeypatch):
    seen, keep = [], B.staged
    monkeypatch.setattr(B, "staged", lambda df, tag: seen.append(df.columns) or keep(df, tag))
    b = B.blocks_by_capacity(points(spark, SF))
    assert b.agg(F.sum("n")).first()[0] == points(spark, SF).count()
    assert set(seen[0]) == {*B.POINT, "gpstime", "pid", "intensity", "red", "_at"}


def test_table_function_answers_equal_texts_once(spark, tmp_path):
    """Keys that differ by 1,800 name equal regions; few rows still become many tasks."""
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(str(tmp_path / "lineitem.parquet"))
    keys = [(s, n) for s in (1, 2, 4) for n in (s, s + 1800, s + 3600)]
    spark.createDataFrame([(n,) for _, n in keys], "s_suppkey long").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    got = registry.QUERIES["udtf_morton_ranges"](spark, str(tmp_path)).collect()
    of = {q: sorted((r.lo, r.hi) for r in got if r.qid == str(q)) for _, q in keys}
    assert all(of[n] == of[s] != [] for s, n in keys)
    assert spark.table("range_regions").count() == 3 and spark.table("range_regions").rdd.getNumPartitions() > 1
