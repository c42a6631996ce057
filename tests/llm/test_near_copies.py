"""The pipeline's near-dedup stage against all pairs at an exact Jaccard similarity of five-word shingles."""

import random

from pointloom.llm import simhash


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    a, b = grams(a), grams(b)
    return not (a or b) or len(a & b) >= 0.8 * len(a | b)


def test_edited_copies_go(spark):
    """A few per cent of the words changed: far more than two bits of a SimHash."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    rows = []
    for i in range(60):
        w = [word() for _ in range(200)]
        copy = list(w)
        for k in r.sample(range(10, 190), 1 + i % 5):
            copy[k] = "changed"
        rows += [(i, " ".join(w)), (1000 + i, " ".join(copy))]
    texts = dict(rows)
    pairs = [i for i in range(60) if near(texts[i], texts[1000 + i])]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = set(texts) - kept
    # every original and every unlike copy stays; eight bands of three find 0.997 of the pairs at 0.8
    assert len(pairs) >= 30 and gone <= {1000 + i for i in pairs} and len(gone) >= len(pairs) - 1


def test_hard_rows(docs, empty, rows):
    """Repeated and null ids, null, empty and copied texts: each group of near copies keeps one text and id."""
    groups = []
    for i, t in rows:
        mine = [g for g in groups if any(near(t, x) for _, x in g)]
        groups = [g for g in groups if g not in mine] + [[(i, t), *(p for g in mine for p in g)]]
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = [(x.doc_id, x.text) for x in got.collect()]
    assert len(set(kept)) == len(groups) and all(len(set(g) & set(kept)) == 1 for g in groups)
    assert simhash.keep_one(empty).count() == 0


def test_simhash_links_count(spark):
    """Eleven distinct words, repeated often but for one edit: fingerprints agree within two bits, sets of five-word
    shingles do not reach the threshold. The stage follows the fingerprints."""
    w = [f"word{i}" for i in range(11)]
    whole = w * 40
    edited = [*whole[:100], "other", "thing", "here", *whole[100:]]
    rows = [(1, " ".join(whole)), (2, " ".join(edited)), (3, " ".join(f"else{i}" for i in range(60)))]
    prints = [simhash.fingerprint(t.encode()) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 < (prints[0] ^ prints[2]).bit_count() and not near(rows[0][1], rows[1][1])
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3]
