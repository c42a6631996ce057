"""Operator 13 against a plain version, and its frames."""

import hashlib
import random
from collections import Counter

import pytest

from pointloom.llm import fill_in_middle as fim


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(i, t):
    t, n = t or "", len(t or "")
    h = sha(f"1:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return i, n, "plain", None, None, sha(t), sha(t)
    p, m, s = t[:a], t[a:b], t[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return i, n, form, a, b - a, sha(out), sha(t)


def outputs(rows):
    return {i: brute(i, t) for i, t in rows}


def test_matches_plain_version(docs, empty, rows):
    got = fim.digests(fim.transformed(fim.stored(docs)))
    assert Counter(map(tuple, got.collect())) == Counter(brute(i, t) for i, t in rows)
    assert fim.digests(fim.transformed(fim.stored(empty))).count() == 0


def test_marks_and_many_frames(spark):
    r = random.Random(2)
    long = "".join(r.choice("aé你🙂<PSM>\n") for _ in range(50_000)).replace("<P>", "").replace("<S>", "").replace("<M>", "")
    rows = [(i, t) for i, t in enumerate(["<P>", "a<S>", "<M", "<<P>", "x", "🙂", "P>", long, "ab" * 8192, "y" * 8192, "z" * 8193] * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fim.transformed(fim.stored(df))
    want = outputs(rows)
    assert {r.doc_id: tuple(r) for r in fim.digests(out).collect()} == want
    assert {r.doc_id: (r.form, sha(r.output)) for r in fim.texts(out).collect()} == {i: (w[2], w[5]) for i, w in want.items()}
    assert {w[2] for w in want.values()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("units", [1, 2, 3, 7])
def test_small_frames(units, monkeypatch):
    """Cuts, sentinels and reads that cross frames anywhere."""
    monkeypatch.setattr(fim, "UNITS", units)
    text = "ab<cé你🙂<P<e>f"
    f = fim.Frames()
    f.add(text)
    n = len(text)
    for a in range(n + 1):
        for b in range(a, n + 1):
            assert "".join(f.read(a, b)) == text[a:b]
            for form in ("psm", "spm"):
                out = fim.arranged(f, form, a, b)
                flat = "".join(out.read(0, out.starts[-1]))
                p, m, s = text[:a], text[a:b], text[b:]
                assert flat == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
                assert "".join(fim.restored(out, form)) == text


def test_cuts_open_their_frames_only(monkeypatch):
    f = fim.Frames()
    f.add("word " * 100_000)
    opened = []
    real = fim.Frames.open
    monkeypatch.setattr(fim.Frames, "open", lambda self, i: opened.append(i) or real(self, i))
    fim.arranged(f, "psm", 100_001, 300_003)
    assert sorted(set(opened)) == [100_001 // fim.UNITS, 300_003 // fim.UNITS]
