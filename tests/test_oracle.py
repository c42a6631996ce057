"""Every query with a checking SQL gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from pointloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, float):
            return repr(round(v, 9) + 0.0)
        if isinstance(v, (list, tuple)):
            return str([norm(x) for x in v])
        return str(v)

    return sorted(tuple(norm(r[i]) for i in order) for r in data), sorted(columns)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE[name])
    got, columns = rows(df.columns, [tuple(r) for r in df.collect()])
    expected, names = rows(want.columns, want.fetchall())
    assert columns == names
    assert len(got) == len(expected)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
