"""Operator 11: exact top-k search by inner product.

Vectors become integers, floor(1024 x). They are dealt to slices by descending length, and queries meet the
slices in rounds, longest first: as |<q, v>| <= |q| |v|, a query whose k-th best score exceeds what its length
allows with the longest vector left is done. Within a slice a rotation by the right singular vectors of the
table puts most of every vector into few leading components. Partial products over these, plus the product of
the lengths of what is left (Cauchy-Schwarz), bound a score from above; only pairs whose bound reaches the
query's k-th best score go on to the next components and at last to the exact integer product.

Queries are a stated set and meet the rows in blocks: groups of QUERIES times slices of SLICE rows, as keys of
a cogroup. Nothing of a size that grows with the table is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stage, table

SCALE, TOP, EVERY = 1024, 10, 100
#: Rows of a slice, queries of a group, rows looked at together in a task; sizes of blocks only.
SLICE, QUERIES, BLOCK = 16384, 2048, 1024
#: Slices of the first round; each further round takes GROWTH times as many.
FIRST, GROWTH = 8, 4
#: Bounds are floating-point numbers and count with this part of the lengths on top.
SLACK = 1e-9
#: Largest and smallest score that a long holds; scores beyond it are reported as these.
LIMIT = (1 << 63) - 1


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) of doubles; both steps are exact in doubles."""
    return np.floor(x.astype(np.float64) * SCALE)


def valid(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(rid, vec_id, v)``: rows that take part, ``rid`` telling rows of one id apart. Rows without an id, null
    vectors and those with a null or non-finite component (or one that 1024 times would not be finite) are left out."""
    v = F.col(vector_col).cast("array<double>")
    big = F.lit(float(np.finfo(np.float64).max) / SCALE)
    rows = embeddings.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > big)))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of ``width`` integers; shorter vectors count as followed by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = column.offsets.to_numpy().astype(np.int64)
    flat = scaled(column.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]])
    sizes = np.diff(starts)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts[:-1] - starts[0], sizes)] = flat
    return out


def _lengths(m: np.ndarray) -> np.ndarray:
    """Lengths without overflow."""
    top = np.abs(m).max(axis=1, initial=0.0)
    safe = np.where(top > 0, top, 1.0)
    return np.sqrt(np.square(m / safe[:, None]).sum(axis=1)) * safe


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the table, by descending singular value: the eigenvectors of the sum of v v^T.
    Tasks add up their rows, a second step adds those sums; width^2 numbers come to the driver."""

    def gram(batches):
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column("v"), width)
            unit = m / np.maximum(np.abs(m).max(axis=1, initial=0.0), 1.0)[:, None]  # directions are what counts
            total += unit.T @ unit
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def added(key, rows):
        column = rows.column("row").combine_chunks()
        total = column.values.to_numpy().reshape(-1, width).sum(axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([total], pa.list_(pa.float64()))})

    rows = vectors.select("v").mapInArrow(gram, "i int, row array<double>").groupBy("i").applyInArrow(added, "i int, row array<double>").collect()
    total = np.zeros((width, width))
    for r in rows:
        total[r.i] = r.row
    return np.linalg.eigh(total)[1][:, ::-1]


def _levels(width: int) -> list[int]:
    """Numbers of leading components after which bounds are taken."""
    return sorted({x for x in (width // 8, width // 4, width // 2) if 0 < x < width})


class Side:
    """Integer vectors with their rotated form and the lengths of what each level leaves."""

    def __init__(self, m: np.ndarray, turn: np.ndarray):
        self.exact, self.length = m, _lengths(m)
        self.turned = m @ turn
        self.rest = {k: _lengths(self.turned[:, k:]) for k in _levels(m.shape[1])}


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers: int64 where sums surely fit, Python integers otherwise."""
    top = float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * max(a.shape[1], 1)
    if top < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    if top < 2.0**62:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    whole = lambda m: np.array([int(x) for x in m.ravel()], object).reshape(m.shape)
    return np.array([int(x) for x in (whole(a) * whole(b)).sum(axis=1)], object)


def reaching(q: Side, rows: np.ndarray, v: Side, block: slice, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``rows`` of q and rows of the block whose score can reach ``least``, which is by query."""
    at = np.arange(block.start, block.stop)
    slack = SLACK * q.length[rows] * v.length[at].max(initial=0.0)
    floor = least[rows] - slack
    levels = _levels(q.exact.shape[1])
    first = levels[0] if levels else q.exact.shape[1]
    bound = q.turned[rows, :first] @ v.turned[at, :first].T
    if levels:
        bound += np.outer(q.rest[first][rows], v.rest[first][at])
    i, j = np.nonzero(bound >= floor[:, None])
    for low, high in zip(levels, [*levels[1:], q.exact.shape[1]]):
        if not len(i):
            break
        part = bound[i, j] - q.rest[low][rows[i]] * v.rest[low][at[j]] if low == first else part[keep]
        part = part + np.einsum("ij,ij->i", q.turned[rows[i], low:high], v.turned[at[j], low:high])
        rest = q.rest[high][rows[i]] * v.rest[high][at[j]] if high in q.rest else 0.0
        keep = part + rest >= floor[i]
        i, j = i[keep], j[keep]
    return rows[i], at[j]


class Best:
    """The k best rows of every query so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.q, self.score, self.at = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, q: np.ndarray, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, at = np.concatenate([self.q, q]), np.concatenate([self.at, at])
        score = np.concatenate([self.score.astype(score.dtype) if len(self.score) == 0 else self.score, score])
        order = np.lexsort((at, ids[at], -score, q)) if score.dtype != object else np.array(sorted(range(len(q)), key=lambda x: (q[x], -score[x], ids[at[x]], at[x])), np.int64)
        q, at, score = q[order], at[order], score[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        stay = place < self.k
        self.q, self.at, self.score = q[stay], at[stay], score[stay]
        full = place[stay] == self.k - 1
        self.least[self.q[full]] = np.maximum(self.least[self.q[full]], self.score[full].astype(np.float64))


def search(q: Side, own: np.ndarray, v: Side, rid: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int) -> Best:
    """The best rows of a slice, sorted by descending length, for each query that a row of it can serve."""
    best = Best(len(own), k, least)
    step = max(1, min(BLOCK, 16 * k)) if np.isneginf(least).any() else BLOCK  # a small first block sets thresholds
    start = 0
    while start < len(rid):
        block = slice(start, min(start + step, len(rid)))
        top = v.length[start]
        rows = np.flatnonzero(q.length * top * (1 + SLACK) >= best.least)
        if not len(rows):
            break
        i, j = reaching(q, rows, v, block, best.least)
        other = own[i] != rid[j]
        i, j = i[other], j[other]
        for s in range(0, len(i), 1 << 17):
            a, b = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
            best.add(a, b, products(q.exact[a], v.exact[b]), ids)
        start, step = block.stop, BLOCK
    return best


FOUND = "query_rid long, query_id long, vec_id long, rid long, score decimal(38,0)"
#: Scores of that many digits are held exactly between tasks; larger ones count as this.
HUGE = 10**38 - 1


def _clip(x: int) -> int:
    return max(-HUGE, min(HUGE, int(x)))


def _search_blocks(turn: np.ndarray, width: int, k: int):
    from decimal import Decimal

    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query_rid", "query_id", "vec_id", "rid", "score"]
        kinds = [pa.int64()] * 4 + [pa.decimal128(38, 0)]
        if not queries.num_rows or not rows.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        v = Side(_matrix(rows.column("v"), width), turn)
        order = np.lexsort((rows.column("rid").to_numpy(), -v.length))
        rows = rows.take(pa.array(order))
        v.exact, v.length, v.turned = v.exact[order], v.length[order], v.turned[order]
        v.rest = {level: x[order] for level, x in v.rest.items()}
        q = Side(_matrix(queries.column("v"), width), turn)
        own, ids, rid = queries.column("rid").to_numpy(), rows.column("vec_id").to_numpy(), rows.column("rid").to_numpy()
        best = search(q, own, v, rid, ids, queries.column("least").to_numpy(), k)
        qid = queries.column("vec_id").to_numpy()
        columns = [own[best.q], qid[best.q], ids[best.at], rid[best.at], [Decimal(_clip(x)) for x in best.score]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def _dealt(rows: DataFrame, parts: int, name: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows with the number of their part by descending length, the staged table behind them, and the last number.
    Ranges are joined to ``parts`` where Spark made more of them."""
    order = [F.desc("length"), F.asc("vec_id"), F.asc("rid")]
    made = stage(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), name)
    ranges = (made.agg(F.max("_range")).first()[0] or 0) + 1
    fewer = min(parts, ranges)
    return made.withColumn(name, F.floor(F.col("_range") * fewer / ranges).cast("int")).drop("_range"), made, fewer - 1


def top_inner_products(embeddings: DataFrame, k: int = TOP, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the k best rows for every row whose id ``every`` divides.

    Vectors are turned into integers, and scores are exact; ties go to the smaller id. A row is never its own
    answer, but another row that repeats its id can be one, and each such row is a query of its own. See
    :func:`valid` for rows that take no part; shorter vectors count as followed by zeros, empty ones as zero.
    Scores are compared up to 38 digits, larger ones count alike; those beyond a long are reported as the greatest
    or least long. An empty table gives no rows; other
    columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = valid(embeddings, id_col, vector_col)
    n, queries_n, width = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max(F.size("v"))).first()
    if not n or not queries_n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    turn = rotation(rows, width)

    def measured(batches):
        for batch in batches:
            length = _lengths(_matrix(batch.column("v"), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length)], [*batch.schema.names, "length"])

    ranked = rows.mapInArrow(measured, "rid long, vec_id long, v array<double>, length double")
    slices, all_slices, last = _dealt(ranked, -(-n // SLICE), "slice")
    longest = stage(slices.groupBy("slice").agg(F.max("length").alias("longest")), "longest")
    queries, all_queries, _ = _dealt(slices.filter(F.col("vec_id") % every == 0).drop("slice"), -(-queries_n // QUERIES), "grp")
    best = None
    low, size = 0, FIRST
    while low <= last:
        high = min(low + size, last + 1)
        alive = queries.withColumn("least", F.lit(float("-inf")))
        if best is not None:
            kth = best.filter(F.col("rank") == k).select(F.col("query_rid").alias("rid"), F.col("score").cast("double").alias("kth"))
            alive = queries.join(kth.hint("shuffle_merge"), "rid", "left").withColumn("least", F.coalesce("kth", F.lit(float("-inf")))).drop("kth")
        # the longest vector that a query of the group still needs, and the slices that hold any of that length
        need = F.min(F.when(F.col("least") <= 0, 0.0).when(F.col("length") > 0, F.col("least") * (1 - 2 * SLACK) / F.col("length")).otherwise(float("inf")))
        meets = alive.groupBy("grp").agg(need.alias("need")).select("grp", "need", F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("slice"))
        meets = stage(meets.join(longest.hint("shuffle_merge"), "slice").filter("longest >= need").select("grp", "slice"), "meets")
        if meets.isEmpty():
            release(meets)
            break
        left = alive.join(meets.hint("shuffle_hash"), "grp").groupBy("grp", "slice")
        right = slices.filter(F.col("slice").between(low, high - 1)).join(meets.hint("shuffle_hash"), "slice").groupBy("grp", "slice")
        found = left.cogroup(right).applyInArrow(_search_blocks(turn, width, k), FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        order = Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id", "rid")
        ranked = stage(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        release(meets, *([best] if best is not None else []))
        best, low, size = ranked, high, size * GROWTH
    release(all_slices, longest, all_queries)
    bounded = F.greatest(F.least("score", F.lit(LIMIT).cast("decimal(38,0)")), F.lit(-LIMIT).cast("decimal(38,0)"))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", bounded.cast("long").alias("score"))


def op11_exact_top_k(spark, sf_dir):
    """The ten best rows of every hundredth id, over the whole table."""
    return top_inner_products(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM (SELECT * FROM e WHERE vec_id % 100 = 0) q JOIN e c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""
