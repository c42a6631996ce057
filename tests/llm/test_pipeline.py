"""The pipeline against a brute-force run of its stages."""

import re

import corpus_pipeline
from pointloom.llm import quality

from .conftest import SF
from .test_near_copies import near
from .test_operators import ALNUM, LOW, brute_quality, char_grams, find


def expected(docs, bench):
    """Texts by id, stage by stage."""
    kept = {i: t for i, t in docs.items() if brute_quality(t)[0] >= 20 and not any(rule(quality.Text(t.encode())) for rule in quality.RULES.values())}
    place = {}
    for i, t in kept.items():
        for p, x in enumerate(t.split("\n")):
            if x.strip():
                place.setdefault(x, []).append((i, p))
    lines, posts = list(place), {}
    sets, parent = [char_grams(x) for x in lines], list(range(len(lines)))
    for a in range(len(lines)):
        shared = {}
        for g in sets[a]:
            for b in posts.get(g, ()):
                shared[b] = shared.get(b, 0) + 1
            posts.setdefault(g, []).append(a)
        for b, n in shared.items():
            if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
                parent[find(parent, a)] = find(parent, b)
    best = {}
    for a, x in enumerate(lines):
        best[find(parent, a)] = min([*place[x], *([best[find(parent, a)]] if find(parent, a) in best else [])])
    gone = {o for a, x in enumerate(lines) for o in place[x] if o != best[find(parent, a)]}
    kept = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in kept.items()}
    ids = sorted(kept)
    parent = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if near(kept[ids[a]], kept[ids[b]]):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    kept = {i: kept[i] for a, i in enumerate(ids) if find(parent, a) == a}
    words = lambda t: re.findall(ALNUM, t.translate(LOW))
    wins = {tuple(w[s : s + min(13, len(w))]) for w in map(words, bench) for s in range(max(len(w) - 12, 1)) if w}
    out = {}
    for i, t in kept.items():
        w = words(t)
        hit = {p for n in {len(x) for x in wins} for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in wins for p in range(s, s + n)}
        if not hit or 20 * len(hit) < len(w):
            out[i] = t
    return out


def test_pipeline(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = expected(docs, bench)
    from pointloom.llm import pieces, tokens

    coder = pieces.loaded(tokens.vocabulary_path(pieces.MODEL))
    import numpy as np

    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    # the bands of line dedup find 0.985 of the pairs at a similarity of 0.8, so a line in some hundreds can stay
    same = [coder.decode(np.array(got[i])) == t for i, t in want.items()]
    assert sum(same) >= 0.99 * len(same)
    for i, t in want.items():
        assert set(t.split("\n")) <= set(coder.decode(np.array(got[i])).split("\n"))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece_encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def folder(spark, docs, path):
    docs.write.parquet(str(path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_hard_rows(spark, docs, unique, tmp_path):
    """Nulls, empty and very long texts, copies, extra columns with clashing names; stages also with repeated and
    absent ids."""
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.count() <= docs.count()
    once = docs.filter(docs.doc_id.isin(list(unique)))
    got = [r.doc_id for r in corpus_pipeline.run(spark, folder(spark, once, tmp_path)).collect()]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(got) == sorted(expected({i: t or "" for i, t in unique.items()}, bench))


def test_no_rows(spark, docs, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, docs.limit(0), tmp_path)).count() == 0
