"""Operator 12 against counts of all phrases in Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from pointloom.llm import collocations as co

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        found = [g for g, a in c.items() if len(g) > 1 and a >= least]
        inside = set()
        for g in found:
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    if 100 * c[g] >= 100 * c[g[i : i + k]]:
                        inside.add(g[i : i + k])
        scored = []
        for g in found:
            if g not in inside:
                score, cut = min((1000 * c[g] * n[lang] // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -c[g], " ".join(g).encode(), c[g[:cut]], c[g[cut:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):  # noqa: E741
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return out


def some_texts():
    r = random.Random(3)
    words = ["a", "of", "the", "New", "York", "city", "é", "ß", "x\x1cy", " ", "你好", "wall", "street", "#1", "0"]
    phrases = ["the city of New York", "wall street", "a b c d e f g h", "of the", "a a a a a a a", "x\x1cy é ß"]
    out = []
    for i in range(400):
        t = []
        for _ in range(r.randrange(1, 40)):
            t.append(r.choice(phrases) if r.random() < 0.5 else r.choice(words) if r.random() < 0.9 else f"rare{r.randrange(500)}")
            if r.random() < 0.15:
                t.append(r.choice([".", ",", " ; ", "!?", "\n", "\r\n", "\x0b", "\t"]))
        out.append((r.choice(["en", "en", "en", None, "und", "", "de"]), (" " if r.random() < 0.8 else "  ").join(t)))
    return out + [("en", None), (None, ""), ("fr", "   "), ("it", "solo"), ("en", "the city " * 3000), ("en", out[0][1])]


@pytest.fixture(scope="module")
def few(spark):
    rows = some_texts()
    return rows, spark.createDataFrame([(lang, t, 0, "x", "x", "x") for lang, t in rows], "lang string, text string, k int, words string, n string, code string").repartition(5)


@pytest.mark.parametrize("least, top", [(2, 10_000), (10, 40)])
def test_matches_all_counts(few, least, top):
    rows, df = few
    assert set(map(tuple, co.collocations(df, least, top).collect())) == brute(rows, least, top)


@pytest.mark.parametrize("words, hot, hottest, together", [(0, 1 / 256, 1 / 32, 1 << 20), (1 << 20, 1e-9, 1e-9, 300), (0, 0.02, 0.05, 300), (1 << 20, 1e-9, 0.05, 1)])
def test_hashes_salts_and_small_batches(spark, few, monkeypatch, words, hot, hottest, together):
    monkeypatch.setattr(co, "WORDS", words)
    monkeypatch.setattr(co, "HOT_SHARE", hot)
    monkeypatch.setattr(co, "HOTTEST", hottest)
    monkeypatch.setattr(co, "TOGETHER", together)
    rows, df = few
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        assert set(map(tuple, co.collocations(df, 5, 100).collect())) == brute(rows, 5, 100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark, few, docs):
    assert co.collocations(few[1].limit(0)).count() == 0
    assert co.collocations(few[1].filter("text is null")).count() == 0
    assert co.collocations(docs, 3).filter("lang <> 'und'").count() == 0


def test_word_codes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("en", "é"), ("", "x\x1cy"), ("und", "a" * 100)], "lang string, word string")
    for r in df.withColumn("h", F.xxhash64(F.lit(3).cast("long"), "lang", "word")).collect():
        assert co.word_code(r.lang, r.word.encode(), 3) == r.h
