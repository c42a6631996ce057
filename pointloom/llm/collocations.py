"""Operator 12: phrase collocations from a weighted de Bruijn graph.

Edges of the graph are runs of LONGEST words, leading from the node of their first four words to the node of
their last four. Every place of a piece gives one edge; near a piece's end the edge is short, padded with END,
and so carries the correction that shorter phrases need there. Only edges are shuffled. Sorted by their words
they yield all shorter counts as flow through nodes: the count of four words is what leaves that node, that of
three what leaves the nodes that begin so, and so on. Words under the least count end a piece, as no phrase
worth reporting holds one. Nodes all of whose flow runs through one edge lie on a unary path and are compacted
into it: their phrases are those of a longer candidate of equal count.

Hot words: a word of over HOT_SHARE of all words has the edges that begin with it dealt by their third word, one
of over HOTTEST by their third and fourth.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, mix, release, stage, table

LONGEST, LEAST, TOP = 5, 100, 2000
#: Ends of pieces and separators of words, beside the space; fixed values of the contract.
BREAKS, TAB = b".,;:!?\n\x0b\x0c\r", b"\t"
UNKNOWN = "und"
#: A dictionary of up to so many words and bytes is broadcast and numbers words, 21 bits each; beyond it edges
#: carry 64-bit hashes of words.
WORDS, WORD_BYTES, BITS = 1 << 20, 1 << 26, 21
#: There are at most 1 / HOT_SHARE hot words, each dealt to SALTS tasks; salts of the hottest come after the others'.
HOT_SHARE, HOTTEST, SALTS = 1 / 256, 1 / 32, 64
#: Languages of a bounded number are broadcast with their totals.
LANGS = 10_000
#: Words of edges and distinct words that a task counts together.
TOGETHER, DISTINCT = 1 << 20, 1 << 20
#: Marks the end of a piece, as a byte that UTF-8 never holds and as the word that pads edges.
BREAK, END = b"\xff", 0
TABLE = bytes.maketrans(UPPER.encode() + BREAKS + TAB, LOWER.encode() + BREAK * len(BREAKS) + b" ")


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words of a text, with BREAK wherever pieces meet."""
    return text.translate(TABLE).replace(BREAK, b" " + BREAK + b" ").split()


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")
    return docs.select(lang, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_code(lang: str | bytes, word: bytes, seed: int) -> int:
    """What Spark's ``xxhash64(seed, lang, word)`` gives, as a signed number."""
    h = xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang, seed_hash(seed)))
    return h - (1 << 64) if h >> 63 else h


def seed_hash(seed: int) -> int:
    return xxhash.xxh64_intdigest(int(seed).to_bytes(8, "little"), 42)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of every word of every language."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            rows = [(lang, w.decode(), n) for (lang, w), n in counts.items()]
            columns = list(zip(*rows)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                by_lang.setdefault(lang, Counter()).update(tokens(text.as_py().encode()))
            for lang, found in by_lang.items():
                del found[BREAK]
                for word, n in found.items():
                    counts[lang, word] += n
            if len(counts) >= DISTINCT:
                yield out()
                counts.clear()
        yield out()

    return _texts(docs).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Coder:
    """Turns words into numbers: those of the dictionary (END for others), or hashes where there is none."""

    def __init__(self, dictionary: dict | None, hot: list[int], hottest: list[int], seed: int):
        self.dictionary, self.seed = dictionary, seed
        self.hot, self.hottest = np.array(hot, np.int64), np.array(hottest, np.int64)
        self.known: dict[str, dict] = {}

    def __call__(self, lang: str, words: list[bytes]) -> np.ndarray:
        if self.dictionary is not None:
            get = self.dictionary.get(lang, {}).get
            return np.fromiter((get(w, END) for w in words), np.int64, len(words))
        known = self.known.setdefault(lang, {BREAK: END})
        if len(known) > DISTINCT:
            known.clear()
            known[BREAK] = END
        for w in set(words).difference(known):
            known[w] = word_code(lang, w, self.seed)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def edges_of(codes: np.ndarray, coder: Coder, wide: bool) -> list[np.ndarray]:
    """Columns of the distinct edges of texts in a row, each text followed by END: salt and words (see
    :func:`packed`) and counts. Sorted, as neighbours of one beginning shrink well."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(LONGEST - 1, np.int64)])
    words = [padded[:n]]
    for j in range(1, LONGEST):
        words.append(np.where(words[-1] == END, END, padded[j : j + n]))
    first = words[0] != END
    words = [w[first] for w in words]
    third = mix(words[2].view(np.uint64))
    dealt = lambda h: (h % np.uint64(SALTS)).astype(np.int64) + 1
    salt = np.where(np.isin(words[0], coder.hot), dealt(third), 0)
    salt = np.where(np.isin(words[0], coder.hottest), SALTS + dealt(mix(third ^ words[3].view(np.uint64))), salt)
    columns = [salt, *words] if wide else packed(salt, words)
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(fresh)
    return [*(c[at] for c in columns), np.diff(np.append(at, len(order)))]


def packed(salt: np.ndarray, words: list[np.ndarray]) -> list[np.ndarray]:
    """Two numbers, head and tail, for an edge of dictionary words; they sort as the words do."""
    w = words
    return [salt << 2 * BITS | w[0] << BITS | w[1], w[2] << 2 * BITS | w[3] << BITS | w[4]]


def unpacked(head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    m = (1 << BITS) - 1
    return head >> 2 * BITS, [head >> BITS & m, head & m, tail >> 2 * BITS, tail >> BITS & m, tail & m]


def edge_keys(wide: bool) -> list[str]:
    return ["salt", *(f"w{j}" for j in range(1, LONGEST + 1))] if wide else ["head", "tail"]


def edges(docs: DataFrame, coder, wide: bool) -> DataFrame:
    """Edges with their counts within tasks: ``(tail, head, n)``, or ``(salt, w1 … w5, n)`` where wide.
    ``coder`` is a broadcast of a :class:`Coder`."""
    keys = edge_keys(wide)
    names = [*keys, "n"] if wide else [*keys[::-1], "n"]  # zeros at the head's end meet those of n and shrink with them

    def run(batches):
        code = coder.value
        held, total = [], 0

        def out():
            found = dict(zip([*keys, "n"], edges_of(np.concatenate(held), code, wide)))
            rows = pa.RecordBatch.from_arrays([pa.array(found[c], pa.int64()) for c in names], names)
            return [rows.slice(i, 1 << 16) for i in range(0, rows.num_rows, 1 << 16)]

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                held += [code(lang, tokens(text.as_py().encode())), np.zeros(1, np.int64)]
                total += len(held[-2])
                if total >= TOGETHER:
                    yield from out()
                    held, total = [], 0
        if held:
            yield from out()

    return _texts(docs).mapInArrow(run, ", ".join(f"{c} long" for c in names))


class Flow:
    """Counts of the nodes of one length, over sorted edges that come batch by batch."""

    def __init__(self, k: int):
        self.k, self.last, self.sum = k, None, 0

    def add(self, salt: np.ndarray, words: list[np.ndarray], count: np.ndarray) -> list[tuple]:
        whole = words[self.k - 1] != END
        columns = [salt[whole], *(w[whole] for w in words[: self.k])]
        count = count[whole]
        if not len(count):
            return []
        fresh = np.ones(len(count), bool)
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        at = np.flatnonzero(fresh)
        keys, sums = np.stack([c[at] for c in columns]), np.add.reduceat(count, at)
        done = []
        if self.last is not None:
            if (keys[:, 0] == self.last).all():
                sums[0] += self.sum
            else:
                done.append((self.last[:, None], np.array([self.sum])))
        self.last, self.sum = keys[:, -1], int(sums[-1])
        done.append((keys[:, :-1], sums[:-1]))
        return done

    def end(self) -> list[tuple]:
        return [] if self.last is None else [(self.last[:, None], np.array([self.sum]))]


def node_counts(found: DataFrame, wide: bool, names, least: int) -> DataFrame:
    """``(k, words, n)`` of all phrases of 2 to LONGEST words that occur ``least`` times or more.

    All edges that begin with two words (those of a hot first word: with three, of the hottest: with four) meet in
    one task, sorted; it adds them up in one pass, keeping one open node of each length. Counts of fewer words
    than that are sums by salt, added up in a second step. ``names`` is a broadcast of the hashes that the
    dictionary's numbers stand for, or None.
    """
    keys = edge_keys(wide)
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ["salt", "w1", "w2"] if wide else ["head"]

    def run(batches):
        flows = [Flow(k) for k in range(2, LONGEST + 1)]
        codes = names.value if names is not None else None

        def out(k, done):
            for key, sums in done:
                stay = (sums >= least) | ((key[0] > 0) & (k < 3)) | ((key[0] > SALTS) & (k < 4))
                words = key[1:, stay].T.ravel()
                words = words if codes is None else codes[words]
                n = int(stay.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(words, pa.int64()))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), lists, pa.array(sums[stay], pa.int64())], ["k", "words", "n"])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in keys]
            salt, words = (columns[0], columns[1:]) if wide else unpacked(*columns)
            count = batch.column("n").to_numpy()
            for f in flows:
                yield from out(f.k, f.add(salt, words, count))
        for f in flows:
            yield from out(f.k, f.end())

    sums = found.repartition(parts, *dealt).sortWithinPartitions(*keys).mapInArrow(run, "k int, words array<long>, n long")
    return sums.groupBy("k", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _coded(words: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``(code, lang, word, n)`` of the words that occur often enough, under a seed without a collision."""
    often = words.filter(F.col("n") >= least)
    for seed in range(100):
        coded = stage(often.select(F.xxhash64(F.lit(seed).cast("long"), "lang", "word").alias("code"), "lang", "word", "n"), "codes")
        n, different, none = coded.agg(F.count("*"), F.count_distinct("code"), F.count(F.when(F.col("code") == END, 1))).first()
        if n == different and not none:
            return coded, seed
        release(coded)
    raise RuntimeError("word hashes collide under every seed")


def _dictionary(coded: DataFrame) -> tuple[dict, np.ndarray] | None:
    """Numbers of the words by language, and the codes by number; None beyond WORDS or WORD_BYTES."""
    n, size = coded.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word").cast("long")), F.lit(0))).first()
    if n > WORDS or size > WORD_BYTES:
        return None
    numbers: dict[str, dict] = {}
    codes = [END]
    for r in coded.orderBy(F.desc("n"), "code").toLocalIterator():  # small numbers for frequent words
        numbers.setdefault(r.lang, {})[r.word.encode()] = len(codes)
        codes.append(r.code)
    return numbers, np.array(codes, np.int64)


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``grams(k, words, n)`` of all phrases of 1 to LONGEST words that occur ``least`` times or more (words as
    codes), ``coded(code, lang, word, n)`` and ``totals(lang, total)``, staged."""
    spark = docs.sparkSession
    words = stage(word_counts(docs), "words", compression="zstd")
    totals = stage(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    coded, seed = _coded(words, least)
    release(words)
    total = totals.agg(F.sum("total")).first()[0] or 0
    often = coded.filter(F.col("n") > total * HOT_SHARE).select("code", "n").collect()  # 1 / HOT_SHARE at most
    hot, hottest = [r.code for r in often], [r.code for r in often if r.n > total * HOTTEST]
    found = _dictionary(coded)
    if found is None:
        coder, names = Coder(None, hot, hottest, seed), None
    else:
        numbers, codes = found
        places = lambda some: (np.flatnonzero(np.isin(codes[1:], np.array(some, np.int64))) + 1).tolist()
        coder, names = Coder(numbers, places(hot), places(hottest), seed), spark.sparkContext.broadcast(codes)
    wide = found is None
    longer = node_counts(edges(docs, spark.sparkContext.broadcast(coder), wide), wide, names, least)
    grams = stage(coded.select(F.lit(1).alias("k"), F.array("code").alias("words"), "n").unionByName(longer), "grams")
    return grams, coded, totals


def compacted(grams: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates that do not lie on a unary path: no phrase of one more word, before or after, occurs as often.
    (A phrase inside a longer one of equal count is inside one of each length between, of that count too.)"""
    longer = grams.filter("k > 2")
    ends = F.array(F.slice("words", 1, F.col("k") - 1), F.slice("words", 2, F.col("k") - 1))
    through = longer.select(F.explode(ends).alias("words"), F.col("n").alias("most")).groupBy("words").agg(F.max("most").alias("most"))
    return candidates.join(through.hint("shuffle_merge"), "words", "left").filter(F.col("most").isNull() | (F.col("most") < F.col("n"))).drop("most")


def scored(grams: DataFrame, coded: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, words, a, l, r, n, score)`` of all candidates that are left, by their lowest-scoring cut."""
    left = compacted(grams, grams.filter("k > 1"))
    home = coded.select(F.col("code").alias("first"), "lang")
    few = totals.limit(LANGS + 1).count() <= LANGS
    home = home.join(F.broadcast(totals) if few else totals, "lang")
    left = left.withColumn("first", F.element_at("words", 1)).join(home.hint("shuffle_merge"), "first").drop("first")
    cuts = left.select("lang", "total", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("lw", F.slice("words", F.lit(1), F.col("cut"))).withColumn("rw", F.slice("words", F.col("cut") + 1, F.size("words") - F.col("cut")))
    part = lambda name, count: grams.select(F.col("words").alias(name), F.col("n").alias(count)).hint("shuffle_merge")
    cuts = cuts.join(part("lw", "l"), "lw").join(part("rw", "r"), "rw")
    # 1000 a n has at most 38 digits up to 10^17 words; div of decimals is exact
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(total as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.groupBy("words").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"), F.first("lang").alias("lang"), F.first("total").alias("n"), F.first("a").alias("a"))
    return best.select("lang", "words", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` collocations.

    Null languages count as ``und``; null and empty texts have no words, repeated rows count each time; ids and
    other columns are ignored; an empty table gives no rows.
    """
    grams, coded, totals = phrase_counts(docs, least)
    found = scored(grams, coded, totals)
    # ties at the last rank are all kept until phrases are known
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    found = stage(found.withColumn("place", F.rank().over(first)).filter(F.col("place") <= top).drop("place"), "found")
    release(grams)
    each = found.select("words", F.posexplode("words").alias("pos", "code")).join(coded.select("code", "word").hint("shuffle_merge"), "code")
    spelled = each.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.join(spelled, "words").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    out = stage(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    release(found, coded, totals)
    return out


def op12_phrase_collocations(spark, sf_dir):
    """The first 2,000 collocations of each language over all texts."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, id, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
x AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda s: w[s : s + k - 1])) AS g FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS c FROM x GROUP BY ALL),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
a AS (SELECT * FROM f WHERE k > 1 AND c >= 100),
gone AS (SELECT DISTINCT lang, g, c FROM (SELECT lang, g[1 : k - 1] AS g, c FROM a WHERE k > 2 UNION ALL SELECT lang, g[2 : k] AS g, c FROM a WHERE k > 2)),
e AS (SELECT a.*, unnest(range(1, k)) AS cut FROM a ANTI JOIN gone USING (lang, g, c)),
s AS (SELECT e.lang, array_to_string(e.g, ' ') AS phrase, e.c AS a, l.c AS l, r.c AS r, n.n, cut, CAST((CAST(1000 AS HUGEINT) * e.c * n.n) // (CAST(l.c AS HUGEINT) * r.c) AS BIGINT) AS score
      FROM e JOIN n USING (lang) JOIN f l ON l.lang = e.lang AND l.g = e.g[1 : e.cut] JOIN f r ON r.lang = e.lang AND r.g = e.g[e.cut + 1 : e.k]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
"""
