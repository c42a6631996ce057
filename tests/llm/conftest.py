import random

import pytest

SF = "/root/testdata/sf0.001"
EXTRA = ["th", "fp", "n", "c", "words", "spans", "gone", "_gone", "_d", "_h", "_lost", "grp", "key", "a", "line", "component"]


def texts():
    """Ids and texts: nulls, empty and blank ones, a long one, copies, near copies, shared passages, ties."""
    r = random.Random(5)
    word = lambda: "".join(r.choice(["an", "der", "é", "lo", "thi", "X", "ing"]) for _ in range(r.randrange(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    base = [line(r.randrange(5, 140)) + "\n" + line(r.randrange(3, 60)) for _ in range(12)]
    passage = line(75)
    out = list(base)
    out += [base[0], base[0], base[1] + " tail", base[2].replace("an", "AN", 1), base[3] + "\n" + base[4]]
    out += [line(20) + " " + passage + " " + line(9), passage + ".", line(70) + "\n" + passage + "\n" + line(4)]
    out += [None, "", "   \n\t", "x", "To " * 300, "ab" * 4000, line(3000), "a\x1cb <|endoftext|> ΣΑΣ İ 你好 🙂", base[5].split("\n")[0] + "\n" + base[5].split("\n")[0]]
    out += ["cc by cc-by General public LICENSE all rights reserved. Licensed under the Apache License, Version 2.0"]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def rows():
    found = texts()
    return found + [(0, found[0][1]), (3, "other text of a repeated id"), (None, found[1][1])]


@pytest.fixture(scope="session")
def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(i, t, None, "s", None, *["e"] * len(EXTRA)) for i, t in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def unique(rows):
    """Rows whose id stands once, by id."""
    ids = [i for i, _ in rows]
    return {i: t for i, t in rows if i is not None and ids.count(i) == 1}
