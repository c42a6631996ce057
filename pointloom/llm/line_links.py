"""Exact links between lines that share a band of their signature, by DataFrame functions alone.

Rows that share a band key are a bucket, of any size. No pairs of a group of near copies are made:

1. Of each bucket those rows stay that agree with another one of it in enough signature values (a semi-join, so a row
   comes out once however many it agrees with). Only these are fetched, and each gets a bitmap of its shingles.
2. In STARS rounds each row meets one leader of each of its buckets that has another label, and is compared with the likest one.
   Labels that are linked become one (not at once all that are connected; that is done before step 3).
3. In buckets of two labels or more, all pairs of different labels are met. Of such a pair that shares several buckets
   the one of the least key makes a row.

A pair is compared exactly unless its bitmaps rule it out: a bit that is set on one side alone stands for a shingle of
that side alone, and two sets of a Jaccard similarity t differ in no more than (1 - t) / (1 + t) of the sum of their
sizes. Buckets over BLOCK rows are cut into blocks, so that a task meets two blocks, never a whole bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stage
from .components import components

STARS, BLOCK = 3, 1024
#: Longs of a row's bitmap.
WORDS = 64
#: Bounds are compared with this tolerance, towards further comparison.
EPS = 1e-6


@dataclass(frozen=True)
class Rule:
    """``shingles`` gives the distinct hashes of a row's x, ``agree`` whether the signature values of two rows (``bands`` columns
    each) let them reach the threshold."""

    shingles: Callable[[Column], Column]
    agree: Callable[[list[Column], list[Column]], Column]
    bands: int
    threshold: float

    def maps(self, rows: DataFrame) -> DataFrame:
        """``(id, size, m)`` of ``rows(id, x)``: how many shingles a row has, and their bitmap."""
        one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c)
        word, bit = F.col("h").bitwiseAND(F.lit(WORDS - 1).cast("long")).cast("int"), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(63).cast("long")).cast("int")
        each = rows.repartition(_parts(rows), "id").select("id", F.explode(self.shingles(F.col("x"))).alias("h"))
        each = each.select("id", word.alias("word"), one(bit).alias("bit")).groupBy("id", "word").agg(F.count("*").alias("n"), F.bit_or("bit").alias("bits"))
        words = [F.coalesce(F.max(F.when(F.col("word") == i, F.col("bits"))), F.lit(0).cast("long")) for i in range(WORDS)]
        return each.groupBy("id").agg(F.sum("n").alias("size"), F.array(*words).alias("m"))

    def differ(self, u: str, v: str) -> Column:
        """Bits that are set on one side alone."""
        each = F.zip_with(f"{u}m", f"{v}m", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
        return F.aggregate(each, F.lit(0), lambda n, x: n + x)

    def possible(self, u: str, v: str) -> Column:
        most = (1 - self.threshold) / (1 + self.threshold)
        return self.differ(u, v) <= (F.col(f"{u}size") + F.col(f"{v}size")) * most + EPS

    def true(self, pairs: DataFrame, known: DataFrame) -> DataFrame:
        """Those of ``pairs(u, v, lu, lv)`` with the rows ``known(id, x)`` that reach the threshold, staged."""
        side = lambda c: known.select(F.col("id").alias(c), F.col("x").alias(f"x{c}")).hint("shuffle_merge")
        # the sets cost far more than the bytes that Spark sizes partitions by
        both = pairs.join(side("u"), "u").join(side("v"), "v").repartition(_parts(pairs))
        both = both.select("u", "v", "lu", "lv", self.shingles(F.col("xu")).alias("a"), self.shingles(F.col("xv")).alias("b"))
        both = both.select("u", "v", "lu", "lv", (F.size("a") + F.size("b")).alias("all"), F.size(F.array_intersect("a", "b")).alias("n"))
        j = F.when(F.col("all") > F.col("n"), F.col("n") / (F.col("all") - F.col("n"))).otherwise(1.0)
        return stage(both.filter(j >= self.threshold).select("u", "v", "lu", "lv"), "links")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{side}{c}") for c in rows.columns])


def _met(rows: DataFrame, both: bool) -> tuple[DataFrame, DataFrame]:
    """Two sides of ``rows(k, id, n, ..)`` that meet by ``meet``: each two rows of a bucket of ``n`` rows, from either side (``both``)
    or once. Columns are prefixed by u and v."""
    parts = _parts(rows)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    low, high = (F.lit(0), F.col("blocks") - 1) if both else (F.col("own"), F.col("blocks") - 1)
    key = lambda a, b: F.when(F.col("blocks") == 1, F.col("k")).otherwise(F.xxhash64("k", a, b))
    left = dealt.withColumn("other", F.explode(F.sequence(low, high))).withColumn("meet", key("own", "other"))
    low, high = (F.lit(0), F.col("blocks") - 1) if both else (F.lit(0), F.col("own"))
    right = dealt.withColumn("other", F.explode(F.sequence(low, high))).withColumn("meet", key("other", "own"))
    return tuple(_sided(x.drop("blocks", "other", "n"), side).repartition(parts, f"{side}meet") for x, side in ((left, "u"), (right, "v")))


def _first(pairs: DataFrame) -> DataFrame:
    """Of ``pairs(u, v, lu, lv, d)`` that of each u with the least d."""
    return pairs.groupBy("u").agg(F.min(F.struct("d", "v", "lu", "lv")).alias("one")).select("u", "one.v", "one.lu", "one.lv")


def linked(signed: DataFrame, fetch: Callable[[DataFrame], DataFrame], rule: Rule) -> DataFrame:
    """Links ``(u, v)`` whose components are those of all pairs of ``signed(id, bands, values)`` that share a band, agree in
    enough values and reach the threshold. ``fetch`` gives rows ``(id, x)`` for a table of ids."""
    parts = _parts(signed)
    names = [f"w{b}" for b in range(rule.bands)]
    values = signed.select("id", *[F.coalesce(F.col("values")[b], F.lit(0).cast("long")).alias(w) for b, w in enumerate(names)])
    # buckets of equal members count once; one exchange for the counts and for the members that they choose
    first = signed.select("id", F.explode("bands").alias("k")).filter("k is not null").repartition(parts, "k")
    same = [F.bit_xor(F.xxhash64(F.lit(i), "id")).alias(f"s{i}") for i in (1, 2)]
    counts = first.groupBy("k").agg(F.count("*").alias("n"), *same).filter("n > 1")
    chosen = counts.groupBy("n", "s1", "s2").agg(F.min("k").alias("k")).select("k", "n")
    members = stage(first.join(chosen.hint("shuffle_hash"), "k").select("k", "id", "n"), "members")
    valued = stage(members.join(values.hint("shuffle_merge"), "id"), "valued")
    release(members)
    u, v = _met(valued, True)
    agree = rule.agree([F.col(f"u{w}") for w in names], [F.col(f"v{w}") for w in names])
    near = u.join(v.hint("shuffle_merge"), (F.col("umeet") == F.col("vmeet")) & (F.col("uid") != F.col("vid")) & agree, "left_semi")
    near = stage(near.select(F.col("uk").alias("k"), F.col("uid").alias("id")).distinct(), "near")
    release(valued)
    known = stage(fetch(near.select("id").distinct()), "known", compression="zstd")
    info = rule.maps(known).join(near.groupBy("id").agg(F.collect_list("k").alias("ks")).hint("shuffle_merge"), "id")
    info = stage(info.join(values.hint("shuffle_merge"), "id"), "maps")
    maps = info.drop("ks", *names)

    def likest(pairs: DataFrame) -> DataFrame:
        """Of ``pairs(u, v, lu, lv)`` that bitmaps allow, the one of each u that differs in the fewest bits."""
        side = lambda c: _sided(maps, c).withColumnRenamed(f"{c}id", c).hint("shuffle_merge")
        met = pairs.join(side("u"), "u").join(side("v"), "v").filter(rule.possible("u", "v"))
        return _first(met.select("u", "v", "lu", "lv", rule.differ("u", "v").alias("d")))

    links = []

    def judge(pairs: DataFrame) -> DataFrame:
        """Compares pairs, notes links and gives ``(label, to)``: what linked labels become, always a lesser one."""
        links.append(rule.true(pairs, known))
        to = links[-1].groupBy(F.greatest("lu", "lv").alias("label")).agg(F.min(F.least("lu", "lv")).alias("to"))
        for _ in range(2):
            to = stage(to, "labels")
            to = to.join(to.select(F.col("label").alias("to"), F.col("to").alias("next")).hint("shuffle_merge"), "to", "left").select("label", F.coalesce("next", "to").alias("to"))
        return stage(to, "labels")

    def opened(each: DataFrame, turn: int) -> DataFrame:
        """Rows of buckets of two labels or more: ``(k, id, label, n, lead, own)``."""
        lead = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("turn"), "id", "label")).alias("lead")
        open_ = each.groupBy("k").agg(F.count("*").alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1"), lead).filter("l0 < l1")
        return stage(each.join(open_.select("k", "n", F.col("lead.id").alias("lead"), F.col("lead.label").alias("own")).hint("shuffle_merge"), "k"), "open")

    rows = opened(near.withColumn("label", F.col("id")), 0)
    for turn in range(1, STARS + 1):
        pairs = rows.filter("label <> own").select(F.col("id").alias("u"), F.col("lead").alias("v"), F.col("label").alias("lu"), F.col("own").alias("lv")).distinct()
        to = judge(likest(pairs))
        if turn < STARS:
            rows = opened(rows.join(to.hint("shuffle_merge"), "label", "left").select("k", "id", F.coalesce("to", "label").alias("label")), turn)
    # before pairs are made, all that is connected has one label
    named = components(reduce(DataFrame.unionByName, links).select("u", "v"))
    rows = opened(near.join(named.hint("shuffle_merge"), F.col("id") == F.col("node"), "left").select("k", "id", F.coalesce("component", "id").alias("label")), STARS)
    u, v = _met(rows.select("k", "id", "label", "n").join(info.hint("shuffle_merge"), "id"), False)
    once = (F.col("uown") != F.col("vown")) | (F.col("uid") > F.col("vid"))
    least = F.col("uk") == F.array_min(F.array_intersect("uks", "vks"))
    met = u.join(v.hint("shuffle_merge"), (F.col("umeet") == F.col("vmeet")) & (F.col("ulabel") != F.col("vlabel")) & once & agree & rule.possible("u", "v") & least)
    pairs = stage(met.select(F.col("uid").alias("u"), F.col("vid").alias("v"), F.col("ulabel").alias("lu"), F.col("vlabel").alias("lv"), rule.differ("u", "v").alias("d")), "pairs")
    # what one pair of each row links needs no further look
    best = stage(_first(pairs), "best")
    to = judge(best)
    of = lambda c: to.select(F.col("label").alias(f"l{c}"), F.col("to").alias(f"t{c}")).hint("shuffle_merge")
    rest = pairs.join(best.select("u", "v").hint("shuffle_merge"), ["u", "v"], "left_anti").join(of("u"), "lu", "left").join(of("v"), "lv", "left")
    links.append(rule.true(rest.filter(F.coalesce("tu", "lu") != F.coalesce("tv", "lv")).select("u", "v", "lu", "lv"), known))
    release(pairs, best, near, info, known)
    return reduce(DataFrame.unionByName, links).select("u", "v")
