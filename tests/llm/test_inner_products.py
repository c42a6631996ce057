"""Operator 11 against all products by Python integers."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from pointloom.llm import inner_products as ip

SCHEMA = "vec_id long, embedding array<double>, label int, rid long, v string, length string, slice string, score string"


def brute(rows, k, every):
    ok = [(r, i, [math.floor(x * 1024) for x in v]) for r, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for r, i, a in ok:
        if i % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), j, s) for s, j, b in ok if s != r)[:k]
            for rank, (score, j, _) in enumerate(found, 1):
                out[(i, rank, j, max(-ip.LIMIT, min(ip.LIMIT, -score)))] += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, "x", "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


def unit(rng, d):
    v = rng.normal(size=d)
    return [float(x) for x in v / np.linalg.norm(v)]


@pytest.mark.parametrize("sizes", [(16384, 2048, 1024, 8), (16, 3, 4, 1)])
def test_matches_all_products(spark, monkeypatch, sizes):
    for name, value in zip(("SLICE", "QUERIES", "BLOCK", "FIRST"), sizes):
        monkeypatch.setattr(ip, name, value)
    rng = np.random.default_rng(4)
    centers = [unit(rng, 24) for _ in range(5)]
    rows = [(i, [float(x) for x in np.array(centers[i % 5]) + 0.15 * rng.normal(size=24)]) for i in range(240)]
    rows += [(300 + i, rows[7][1]) for i in range(20)]  # ties
    rows += [(20, rows[3][1]), (20, rows[20][1]), (-40, rows[9][1]), (None, rows[1][1])]  # repeated, negative and absent ids
    rows += [(500, None), (520, [None] * 24), (540, [float("nan")] * 24), (560, [float("inf")] * 24), (580, []), (600, [0.5, -3.0]), (620, [0.0] * 24)]
    rows += [(640 + i, [float(x) for x in 40 * rng.normal(size=24)]) for i in range(3)]
    df = frame(spark, rows)
    assert Counter(map(tuple, ip.top_inner_products(df, 10, 20).collect())) == brute(rows, 10, 20)
    assert ip.top_inner_products(df.limit(0)).count() == 0
    assert ip.top_inner_products(df.filter("vec_id % 100 <> 0")).count() == 0


@pytest.mark.parametrize("scale", [1e6, 1e9, 1e40])
def test_large_components(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6) * scale]) for i in range(30)]
    got = {tuple(r) for r in ip.top_inner_products(frame(spark, rows), 4, 10).collect()}
    want = set(brute(rows, 4, 10))
    if scale < 1e20:
        assert got == want
    else:  # beyond 38 digits all count alike; a long holds no more than its limit
        assert len(got) == len(want) and {s for *_, s in got} == {ip.LIMIT, -ip.LIMIT} & {s for *_, s in got}


def test_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5])]
    assert [tuple(r) for r in ip.top_inner_products(frame(spark, rows)).collect()] == [(0, 1, 1, 1024 * 512 * 3)]
    assert ip.top_inner_products(frame(spark, rows[:1])).count() == 0


def test_bounds_prune():
    """On skewed spectra few pairs reach the exact product, and the answer is that of all pairs."""
    rng = np.random.default_rng(0)
    d, n = 32, 4000
    m = ip.scaled(rng.normal(size=(n, d)) * 0.9 ** np.arange(d) * rng.lognormal(size=(n, 1)))
    turn = np.linalg.eigh(m.T @ m)[1][:, ::-1]
    order = np.argsort(-ip._lengths(m), kind="stable")
    v, q = ip.Side(m[order], turn), ip.Side(m[:20], turn)
    seen = []
    real = ip.products
    ip.products = lambda a, b: seen.append(len(a)) or real(a, b)
    try:
        best = ip.search(q, np.arange(20), v, order, order, np.full(20, -np.inf), 10)
    finally:
        ip.products = real
    for i in range(20):
        want = sorted((-int(s), int(j)) for j, s in enumerate(m @ m[i]) if j != i)[:10]
        assert [(-int(s), int(order[at])) for s, at in zip(best.score[best.q == i], best.at[best.q == i])] == want
    assert sum(seen) < 0.1 * 20 * n
