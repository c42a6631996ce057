"""Operator 2: benchmark decontamination with DataFrame functions only.

Every 13-word window of the benchmark is a normalised n-gram. Any 13 consecutive words of a document hold a
whole 7-word block that starts at a multiple of 7, so the scan hashes one block for 7 words and probes the
set of all blocks of all windows; only where a block is found are the (at most 7) windows around it looked up
by hash and compared word by word. Windows of shorter items work alike with their own block size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, alnum_words, stage, table

WINDOW = 13
#: Block and window sets of up to this many rows are broadcast (about 100 bytes each); larger ones are shuffled.
BROADCAST_ROWS = 500_000


def _step(length: int) -> int:
    return 1 if length < 5 else (length + 1) // 2


def _hash(length, words):
    return F.xxhash64(F.lit(length) if isinstance(length, int) else length, words)


def bench_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct ``(l, w, item)``: window length, words and item id. Null ids and wordless items have none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), alnum_words(F.col("text").cast("string")).alias("words"))
    items = items.filter("item is not null and size(words) > 0").withColumn("l", F.least(F.size("words"), F.lit(size)))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("l") + 1))
    return items.select("item", "l", "words", starts.alias("s")).select("l", F.slice("words", F.col("s"), F.col("l")).alias("w"), "item").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``(found, windows)``: found has one row ``s = -1`` for each document row and one for each window that
    occurs: ``(doc_id, th, n_words, s, l, wid)``. ``th`` hashes the text; with doc_id it tells rows apart. Null and empty
    texts have no words and no window; items without an id or a word are no items; rows that repeat an id stay apart by
    their texts; empty tables give no rows; other columns are ignored."""
    windows = stage(bench_windows(benchmark, size).withColumn("wid", _hash(F.col("l"), F.col("w"))), "windows")
    count, lengths = windows.agg(F.count("*"), F.collect_set("l")).first()  # 13 lengths at most
    steps = {length: _step(length) for length in sorted(lengths)}
    small = count * max(steps.values(), default=1) <= BROADCAST_ROWS

    blocks = None
    for length, step in steps.items():
        width = length - step + 1
        some = windows.filter(F.col("l") == length).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(step)), lambda o: _hash(length, F.slice("w", o, width)))).alias("bh")).withColumn("bl", F.lit(length))
        blocks = some if blocks is None else blocks.unionByName(some)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), alnum_words(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    plain = rows.select("doc_id", "th", "n_words", F.lit(-1).alias("s"), F.lit(0).alias("l"), F.lit(0).cast("long").alias("wid"))
    if blocks is None:
        return stage(plain, "hits"), windows

    def scan(length, step):
        width = length - step + 1
        starts = F.when(F.col("n_words") >= width, F.sequence(F.lit(0), (F.col("n_words") - width).cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda p: F.struct(F.lit(length).alias("l"), p.alias("p"), _hash(length, F.slice("words", p + 1, width)).alias("h")))

    mark = F.array(F.struct(F.lit(0).alias("l"), F.lit(-1).alias("p"), F.lit(0).cast("long").alias("h")))
    # beyond the broadcast the marks stay out of the joins, where they would all have one key
    all_scans = [scan(*x) for x in steps.items()]
    probes = rows.select("*", F.explode(F.concat(*([mark] if small else []), *all_scans)).alias("b")).select("doc_id", "th", "n_words", "words", "b.l", "b.p", "b.h")
    table_of = blocks.unionByName(plain.sparkSession.range(1).select(F.lit(0).cast("long").alias("bh"), F.lit(0).alias("bl"))).distinct()
    step_of = F.element_at(F.create_map(*[F.lit(x) for pair in ({0: 1} | steps).items() for x in pair]), F.col("l"))
    first = F.greatest(F.col("p") - step_of + 1, F.lit(0))
    around = {"first": first, "near": F.when(F.col("p") >= 0, F.slice("words", first + 1, F.col("p") - first + F.col("l"))).otherwise(F.array().cast("array<string>"))}
    if small:
        found = probes.join(F.broadcast(table_of), (F.col("h") == F.col("bh")) & (F.col("l") == F.col("bl")))
        found = found.withColumns(around)
    else:  # the text itself must not be carried through the shuffle
        found = probes.withColumns(around).drop("words").join(table_of, (F.col("h") == F.col("bh")) & (F.col("l") == F.col("bl")))
    near = found.select("doc_id", "th", "n_words", "l", "p", "first", "near", F.explode(F.sequence(F.col("first"), F.greatest("p", "first"))).alias("s"))
    near = near.select("doc_id", "th", "n_words", "l", "p", "s", F.slice("near", F.col("s") - F.col("first") + 1, F.greatest("l", F.lit(1))).alias("cw"))
    near = near.filter((F.col("p") < 0) | (F.size("cw") == F.col("l")))
    known = windows.select("wid", "w").distinct()
    known = F.broadcast(known) if small else known
    near = near.withColumn("wid", F.when(F.col("p") < 0, F.lit(0).cast("long")).otherwise(_hash(F.col("l"), F.col("cw"))))
    near = near.join(known.withColumnRenamed("wid", "kid"), (F.col("wid") == F.col("kid")) & (F.col("cw") == F.col("w")), "left")
    out = near.filter((F.col("p") < 0) | F.col("kid").isNotNull()).select("doc_id", "th", "n_words", F.when(F.col("p") < 0, -1).otherwise(F.col("s")).alias("s"), "l", "wid")
    return stage(out if small else out.unionByName(plain), "hits"), windows


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row for each document row: ``(doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated,
    spans)``, spans being the maximal hit word ranges ``(start, end)``.

    Null and wordless texts have no words and no hits. Rows that repeat a doc_id are judged each by its own
    text; equal rows give equal results, as many as there were. Null ids are kept. Empty tables on either
    side give no rows, or rows without hits. Other columns are ignored.
    """
    found, windows = hits(docs, benchmark, size)
    place = F.when(F.col("s") >= 0, F.struct(F.col("s"), (F.col("s") + F.col("l")).alias("e")))
    each = found.groupBy("doc_id", "th").agg(F.sum(F.when(F.col("s") < 0, 1).otherwise(0)).cast("int").alias("copies"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(place)).alias("places"))
    nothing = F.array().cast("array<struct<s:int,e:int>>")

    def add(spans, x):
        last = F.try_element_at(spans, F.lit(-1))
        longer = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(last.s.alias("s"), F.greatest(last.e, x.e).alias("e"))))
        return F.when((F.size(spans) > 0) & (x.s <= last.e), longer).otherwise(F.concat(spans, F.array(x)))

    each = each.withColumn("spans", F.aggregate("places", nothing, add)).drop("places")
    each = each.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.e - x.s))
    pairs = found.filter("s >= 0").select("doc_id", "th", "wid").distinct().join(windows.select("wid", "item"), "wid").select("doc_id", "th", "item").distinct()
    items = pairs.groupBy(F.col("doc_id").alias("di"), F.col("th").alias("ti")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("names"))
    out = each.join(items, F.col("doc_id").eqNullSafe(F.col("di")) & (F.col("th") == F.col("ti")), "left")
    out = out.select("doc_id", "th", "n_words", "n_hit", F.coalesce("n", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.drop("copy")


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept. Null and empty texts stay, repeated rows
    and rows without an id are judged by their own text, empty tables give no rows."""
    bad = contamination(docs, benchmark, size).filter("contaminated").select(F.col("doc_id").alias("_d"), F.col("th").alias("_h")).distinct().hint("shuffle_merge")
    return docs.join(bad, docs.doc_id.cast("long").eqNullSafe(bad._d) & (F.xxhash64(docs.text.cast("string")) == bad._h), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """All rows of ``docs``; hit words go from ``text`` with the separators after them. Null texts stay null; rows
    that repeat doc_id and text get the same text; an empty table gives no rows."""
    bad = contamination(docs, benchmark, size).filter("n_hit > 0").select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), "spans").dropDuplicates(["_d", "_h"])
    word, gap = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    lead = F.regexp_extract(docs.text, f"^{gap}+", 0)
    units = F.regexp_extract_all(docs.text, F.lit(f"{word}+{gap}*"), F.lit(0))
    kept = F.filter(units, lambda u, i: ~F.exists(bad["spans"], lambda x: (i >= x.s) & (i < x.e)))
    joined = docs.join(bad, docs.doc_id.cast("long").eqNullSafe(bad._d) & (F.xxhash64(docs.text.cast("string")) == bad._h), "left")
    text = F.when(bad["spans"].isNull(), docs.text).otherwise(F.concat(lead, F.array_join(kept, ""))).alias("text")
    return joined.select(*[text if c == "text" else docs[c] for c in docs.columns])


def op2_benchmark_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th", "spans")


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS l, array_to_string(list_slice(w, s, s + least(len(w), {WINDOW}) - 1), ' ') AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS s FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, s, array_to_string(list_slice(w, s, s + l - 1), ' ') AS g
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, ls WHERE len(w) >= l)),
m AS (SELECT doc_id, s, dw.l, item FROM dw JOIN bw ON dw.g = bw.g AND dw.l = bw.l),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
