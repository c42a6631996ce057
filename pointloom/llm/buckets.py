"""Exact links within MinHash buckets of any size, shared by the near-duplicate operators.

Rows that share a band key are a bucket. Buckets of a bounded size are compared in tasks, many at once, with
numpy; larger ones lose members in rounds of Spark joins until they are small enough. Both use one rule: all
members meet one of them, the leader, and what the triangle inequality of the Jaccard distance then proves to
be linked or without a link leaves the bucket. A bucket that a round does not halve is dealt anew by its members'
rarest shingles (prefix filtering): two sets of the threshold's similarity share one of the first few of theirs,
so linked members meet again. Where that would not save comparisons, all members being alike but not enough, the
bucket is cut into blocks, and tasks compare two blocks each. So no pairs of a group are emitted and no link inside
a bucket is lost, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, release, stage

#: A bucket of up to so many members, with up to so many shingles in all, is compared in one task.
MEMBERS, SHINGLES = 2048, 1 << 22
#: Shingles of whole buckets that a task looks at together.
TOGETHER = 1 << 20
#: Similarities are compared with this tolerance, towards further comparison.
EPS = 1e-9

#: Shingle hashes of a column of rows, row after row, and the places where rows begin (one more than rows).
Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def array_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a column of arrays of hashes."""
    starts = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
    return values.astype(np.int64).view(np.uint64), starts - starts[0]


def _incidence(values: np.ndarray, starts: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct ``(row, element)``; elements are shingles of a bucket, numbered from 0."""
    row = np.repeat(np.arange(len(bucket)), np.diff(starts))
    values = values ^ mix(bucket.astype(np.uint64) + np.uint64(1))[row]
    order = np.argsort(values, kind="stable")  # rows of equal values stay in order
    values, row = values[order], row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = values[1:] != values[:-1]
    element = np.cumsum(fresh) - 1
    fresh[1:] |= row[1:] != row[:-1]
    return row[fresh], element[fresh], int(element[-1]) + 1 if len(row) else 0


def agreeing(bucket: np.ndarray, values: np.ndarray, agree: int) -> np.ndarray:
    """The rows that agree with another of their bucket in ``agree`` of their ``values`` (a row each) or more."""
    found = np.zeros(len(bucket), bool)
    at, step = np.arange(len(bucket) - 1), 1
    while len(at):
        at = at[at + step < len(bucket)]
        at = at[bucket[at + step] == bucket[at]]
        for i in range(0, len(at), 1 << 16):
            one = at[i : i + (1 << 16)]
            one = one[(values[one] == values[one + step]).sum(axis=1) >= agree]
            found[one] = found[one + step] = True
        step += 1
    return found


def compare(bucket: np.ndarray, values: np.ndarray, starts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(row, leader)`` that connect the rows of each bucket (numbers from 0, ascending) as all their pairs
    of a similarity of ``threshold`` or more would."""
    n = len(bucket)
    row, element, elements = _incidence(values, starts, bucket)
    size = np.bincount(row, minlength=n)
    label = np.arange(n)
    alive = np.ones(n, bool)
    us, vs = [], []
    while True:
        rows = np.flatnonzero(alive)
        if not len(rows):
            break
        # the first row of each bucket leads
        b = bucket[rows]
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
        leader = rows[first][group]
        mark = np.zeros(elements, bool)
        leads = np.zeros(n, bool)
        leads[rows[first]] = True
        mark[element[leads[row]]] = True
        common = np.bincount(row[mark[element]], minlength=n)[rows]
        union = size[rows] + size[leader] - common
        j = np.where(union > 0, common / np.maximum(union, 1), 1.0)
        hit = (j >= threshold) & (rows != leader)
        fresh = hit & (label[rows] != label[leader])
        us.append(rows[fresh])
        vs.append(leader[fresh])
        to = np.arange(n)
        to[label[rows[fresh]]] = label[leader[fresh]]
        label = to[label]
        inside = label[rows] == label[leader]
        near = np.full(len(first), -1.0)
        np.maximum.at(near, group[~inside], j[~inside])
        stay = np.where(inside, (rows != leader) & (near[group] >= 0) & (j <= near[group] + 1 - threshold + EPS), True)
        # a bucket is through when one label is left
        left = rows[stay]
        lead = group[stay]
        low, high = np.full(len(first), n), np.full(len(first), -1)
        np.minimum.at(low, lead, label[left])
        np.maximum.at(high, lead, label[left])
        left = left[(low < high)[lead]]
        alive[:] = False
        alive[left] = True
        some = alive[row]
        row, element = row[some], element[some]
    return np.concatenate([np.empty(0, int), *us]), np.concatenate([np.empty(0, int), *vs])


def _whole(batches, weight: str):
    """Tables of whole buckets of batches sorted by ``k``, of TOGETHER in ``weight`` where buckets allow it."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += int(np.sum(batch.column(weight).to_numpy()))
        if total < TOGETHER:
            continue
        rows = pa.Table.from_batches(held)
        k, size = rows.column("k").to_numpy(), np.cumsum(rows.column(weight).to_numpy())
        whole, at = int(np.searchsorted(k, k[-1])), 0  # the last bucket may go on
        while at < whole:
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, "right"))
            end = whole if end >= whole else int(np.searchsorted(k, k[end]))
            if end <= at:  # one bucket of more
                end = min(whole, int(np.searchsorted(k, k[at], "right")))
            yield rows.slice(at, end - at)
            at = end
        held = rows.slice(whole).to_batches()
        total = int(size[-1] - (size[whole - 1] if whole else 0))
    if held:
        yield pa.Table.from_batches(held)


def _numbers(rows: pa.Table) -> np.ndarray:
    k = rows.column("k").to_numpy()
    return np.cumsum(np.concatenate(([0], (k[1:] != k[:-1]).astype(np.int64))))


def _sorted(members: DataFrame) -> DataFrame:
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(parts, "k").sortWithinPartitions("k")


def _links(members: DataFrame, sets: Sets, threshold: float) -> DataFrame:
    """Links ``(u, v)`` of ``members(k, id, size, x)``, whose buckets are of bounded size."""

    def run(batches):
        for rows in _whole(batches, "size"):
            ids = rows.column("id").to_numpy()
            u, v = compare(_numbers(rows), *sets(rows.column("x").combine_chunks()), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(ids[u], pa.int64()), pa.array(ids[v], pa.int64())], ["u", "v"])

    return _sorted(members.select("k", "id", "x", "size")).mapInArrow(run, "u long, v long")


def _possible(members: DataFrame, signed: DataFrame, agree: int) -> DataFrame:
    """``members(k, id, size)`` without those that agree with no other of their bucket in enough signature values."""

    def run(batches):
        for rows in _whole(batches, "width"):
            values = np.frombuffer(b"".join(rows.column("values").to_pylist()), np.uint16).reshape(rows.num_rows, -1)
            left = rows.select(["k", "id", "size"]).filter(pa.array(agreeing(_numbers(rows), values, agree)))
            yield from left.to_batches()

    both = members.join(signed.select("id", "values").hint("shuffle_merge"), "id").select("k", "id", "size", "values", F.octet_length("values").alias("width"))
    return _sorted(both).mapInArrow(run, "k long, id long, size int")


def _scored(pairs: DataFrame, known: DataFrame, sets: Sets) -> DataFrame:
    """``(u, v, j)`` of ``pairs(u, v)`` with the rows ``known(id, x)``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                m = piece.num_rows
                (a, sa), (b, sb) = sets(piece.column("xu")), sets(piece.column("xv"))
                row, element, elements = _incidence(np.concatenate([a, b]), np.concatenate([sa, sa[-1] + sb[1:]]), np.tile(np.arange(m), 2))
                size = np.bincount(row, minlength=2 * m)
                mark = np.zeros(elements, bool)
                mark[element[row < m]] = True
                common = np.bincount(row[(row >= m) & mark[element]], minlength=2 * m)[m:]
                union = size[:m] + size[m:] - common
                j = np.where(union > 0, common / np.maximum(union, 1), 1.0)
                yield pa.RecordBatch.from_arrays([piece.column("u"), piece.column("v"), pa.array(j)], ["u", "v", "j"])

    side = lambda c: known.select(F.col("id").alias(c), F.col("x").alias(f"x{c}")).hint("shuffle_merge")
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "xu", "xv").mapInArrow(run, "u long, v long, j double")


def _ranked(rows: DataFrame, sets: Sets, threshold: float) -> DataFrame:
    """``(id, token)`` of ``rows(id, x)``: of each set's shingles the rarest, one more than a set of the threshold's
    similarity can lack. Two such sets share one of these, the rarest of all that they share."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                values, starts = sets(piece.column("x"))
                row = np.repeat(np.arange(piece.num_rows), np.diff(starts))
                order = np.lexsort((values, row))
                row, values = row[order], values[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
                ids = piece.column("id").take(pa.array(row[fresh]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(values[fresh].view(np.int64))], ["id", "token"])

    tokens = stage(rows.select("id", "x").mapInArrow(run, "id long, token long"), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("f"))
    each = tokens.join(often.hint("shuffle_merge"), "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("all"))
    lacking = (F.size("all") - F.ceil(F.size("all") * threshold - EPS)).cast("int")
    out = stage(each.select("id", F.explode(F.slice("all", F.lit(1), lacking + 1)).alias("one")).select("id", "one.token"), "ranked")
    release(tokens)
    return out


def _blocks(members: DataFrame) -> DataFrame:
    """Members of crowded buckets, with their bucket's ``left`` and ``all``, dealt to blocks of half the bounds and these
    to new buckets of two, so that each two members meet."""
    n = F.greatest(F.ceil(F.col("left") * 2 / MEMBERS), F.ceil(F.col("all") * 2 / SHINGLES), F.lit(2)).cast("int")
    dealt = members.withColumn("n", n).withColumn("one", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    pairs = dealt.withColumn("two", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).filter("one <> two")
    return pairs.select(F.xxhash64("k", F.least("one", "two"), F.greatest("one", "two")).alias("k"), "id", "size")


def linked(signed: DataFrame, fetch: Callable[[DataFrame], DataFrame], sets: Sets, threshold: float, agree: int = 0) -> DataFrame:
    """Links ``(u, v)`` whose components are those of all pairs of ``signed(id, bands, size)`` that share a band
    and reach the threshold. ``size`` bounds the shingles of a row; ``fetch`` gives rows ``(id, x)`` for a table
    of ids, ``sets`` the shingle hashes that a column of x stands for. Where ``signed`` has ``values`` (16 bits of
    each value of the signature), rows that agree with no other of their bucket in ``agree`` of them are not fetched.

    Buckets of equal members count once. Those within MEMBERS and SHINGLES are compared in tasks. In larger
    ones a round compares all members with the leader. Those that reach the threshold are linked to it and
    share its label from then on; labels that a leader links become one. Pairs of one label need no further
    look. As 1 - j is a metric, a linked member can have a link to an unlinked one of similarity j only if its
    own does not exceed j + 1 - threshold; all others leave the bucket, as does the leader, whose links are all
    known. A bucket that did not shrink by half is dealt anew by rare shingles, once, if the squares of the crowded
    parts add up to less than its own; else its blocks are compared.
    """
    reach = 2 * threshold - 1
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = (F.col("n") <= MEMBERS) & (F.col("total") <= SHINGLES)
    # one exchange for the counts and for the members that they choose
    first = signed.select("id", "size", F.explode("bands").alias("k")).filter("k is not null").repartition(parts, "k")
    counts = first.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("total"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("all")).filter("n > 1")
    chosen = counts.groupBy("n", "total", "all").agg(F.min("k").alias("k")).select("k", fits.alias("fits"))
    members = stage(first.join(chosen.hint("shuffle_merge"), "k").select("k", "id", "size", "fits"), "members")
    small, large = members.filter("fits").drop("fits"), members.filter(~F.col("fits"))
    if agree:
        small = stage(_possible(small, signed, agree), "possible")
    crowded = not large.isEmpty()
    needed = small.select("id").unionByName(large.select("id")) if crowded else small.select("id")
    rows = stage(fetch(needed.distinct()), "some", compression="zstd")
    text = rows.hint("shuffle_merge")
    links = stage(_links(small.join(text, "id"), sets, threshold), "links")
    if agree:
        release(small)
    if not crowded:
        release(members, rows)
        return links
    ranked = _ranked(rows.join(large.select("id").distinct().hint("shuffle_merge"), "id", "left_semi"), sets, threshold)
    members = stage(large.select("k", F.lit(False).alias("dealt"), "id", "size", F.lit(None).cast("int").alias("label")), "members")
    turn = 0
    while True:
        turn += 1
        # members without a label lead first
        lead = F.struct(F.col("label").isNotNull().alias("later"), "id", "label")
        leaders = members.groupBy("k").agg(F.count("*").alias("n"), F.min(lead).alias("lead")).filter("n > 1").select("k", "n", F.col("lead.id").alias("low"), F.col("lead.label").alias("own"))
        met = stage(members.join(leaders.hint("shuffle_merge"), "k").filter("id <> low"), "met")
        release(members)
        pairs = met.filter("label is null or own is null or label <> own").select(F.col("id").alias("u"), F.col("low").alias("v")).distinct()
        scored = stage(_scored(pairs, rows, sets).filter(F.col("j") >= reach), "scored")
        links = links.unionByName(scored.filter(F.col("j") >= threshold).select("u", "v"))
        judged = met.join(scored.select(F.col("u").alias("id"), F.col("v").alias("low"), "j").hint("shuffle_merge"), ["id", "low"], "left")
        # what has the leader's label already counts as linked, at a similarity not known
        same = F.coalesce(F.col("label") == F.col("own"), F.lit(False))
        judged = stage(judged.select("k", "dealt", "id", "size", "n", "label", "own", F.coalesce("j", F.when(same, threshold).otherwise(0.0)).alias("j")), "judged")
        release(met)
        hit = F.col("j") >= threshold
        joined = judged.groupBy("k").agg(F.collect_set(F.when(hit, F.coalesce("label", F.lit(turn)))).alias("ones"))  # at most a label a round
        merged = judged.join(joined.hint("shuffle_merge"), "k").withColumn("in", hit | F.coalesce(F.array_contains("ones", F.col("label")), F.lit(False)))
        merged = merged.withColumn("label", F.when(F.col("in"), F.lit(turn)).otherwise(F.col("label"))).drop("ones", "own")
        merged = stage(merged, "merged")
        release(judged)
        # of each bucket the similarity of the nearest member outside the leader's label
        open_ = merged.filter("not in").groupBy("k").agg(F.max("j").alias("near"))
        rest = merged.join(open_.hint("shuffle_merge"), "k").filter(~F.col("in") | ((F.col("near") >= reach) & (F.col("j") <= F.col("near") + (1 - threshold) + EPS)))
        sizes = rest.groupBy("k").agg(F.count("*").alias("left"), F.sum(F.col("size").cast("long")).alias("all"), F.count("label").alias("known"), F.min("label").alias("l0"), F.max("label").alias("l1"))
        sizes = sizes.filter("left > 1 and (known < left or l0 < l1)").select("k", "left", "all")
        rest = stage(rest.join(sizes.hint("shuffle_merge"), "k").select("k", "dealt", "id", "size", "label", "n", "left", "all"), "rest")
        release(merged)
        again = F.col("left") * 2 <= F.col("n")
        small = (F.col("left") <= MEMBERS) & (F.col("all") <= SHINGLES)
        slow = rest.filter(~small & ~again)
        anew = slow.filter("not dealt").join(ranked.hint("shuffle_merge"), "id").select(F.xxhash64("k", "token").alias("part"), "k", "id", "size", "left")
        known = anew.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("total"), F.first("k").alias("k"), F.first("left").alias("left"))
        known = stage(known.filter("n > 1").select("part", "k", "n", "left", fits.alias("fits")), "parts")
        alike = known.filter("not fits").groupBy("k").agg(F.sum(F.col("n") * F.col("n")).alias("squares"), F.first("left").alias("left")).filter(F.col("squares") >= F.col("left") * F.col("left")).select("k")
        met = stage(anew.select("part", "id", "size").join(known.join(alike.hint("shuffle_merge"), "k", "left_anti").select("part", "fits").hint("shuffle_merge"), "part"), "anew")
        blocks = _blocks(slow.join(alike.withColumn("alike", F.lit(True)).hint("shuffle_merge"), "k", "left").filter(F.col("dealt") | F.col("alike")))
        ready = rest.filter(small).select("k", "id", "size").unionByName(met.filter("fits").select(F.col("part").alias("k"), "id", "size")).unionByName(blocks)
        links = links.unionByName(stage(_links(ready.join(text, "id"), sets, threshold), "links"))
        fresh = met.filter("not fits").select(F.col("part").alias("k"), F.lit(True).alias("dealt"), "id", "size", F.lit(None).cast("int").alias("label"))
        members = stage(rest.filter(~small & again).select("k", "dealt", "id", "size", "label").unionByName(fresh), "members")
        release(rest, known, met)
        if members.isEmpty():
            release(members, rows, ranked)
            return links
