"""Periodic runs against a plain search of all periods of all stretches."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonospark.llm import periodic, queries


def plain_runs(x, min_words=24, min_exp=3):
    """All stretches that are long enough for their smallest period and can't be extended."""
    n, out = len(x), set()
    for q in range(1, n // min_exp + 1):
        s = 0
        while s + q < n:
            if x[s] != x[s + q]:
                s += 1
                continue
            e = s
            while e + q < n and x[e] == x[e + q]:
                e += 1
            size = e - s + q
            if size >= max(min_words, min_exp * q) and not any(all(x[i] == x[i + p] for i in range(s, s + size - p)) for p in range(1, q)):
                out.add((s, size, q))
            s = e + 1
    return sorted(out)


def plain(words):
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    found = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (len(words), *found, [dict(zip(("start", "length", "period"), r)) for r in runs], " ".join(w for i, w in enumerate(words) if i not in gone))


def corpus(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        while len(words) < rng.randrange(5, 160):
            if rng.random() < 0.5:
                stretch = [f"w{rng.randrange(rng.choice([2, 3, 40]))}" for _ in range(rng.randrange(1, 30))]
                words += stretch * rng.randrange(1, 7) + stretch[: rng.randrange(len(stretch) + 1)]
            else:
                words += [f"w{rng.randrange(4)}" for _ in range(rng.randrange(20))]
        if rng.random() < 0.3 and words:
            words[rng.randrange(len(words))] = "é"
        out.append(words)
    return out


TEXTS = corpus(1, 60)


@pytest.mark.parametrize("dense", [0, 1 << 20])
@pytest.mark.parametrize("block", [1, 100, 1 << 17])
def test_runs(monkeypatch, dense, block):
    monkeypatch.setattr(periodic, "DENSE", dense)
    monkeypatch.setattr(periodic, "BLOCK", block)
    found = 0
    for words in TEXTS:
        x = periodic.numbered([w.encode() for w in words])
        want = plain_runs(words)
        assert periodic.runs_of(x) == want
        top, parts = len(x) // 3, {}
        for k in range(3):
            for s, n, q in periodic.runs_of(x, top * k // 3 + 1, top * (k + 1) // 3 + 1):
                parts[s, n] = min(q, parts.get((s, n), q))
        assert sorted((s, n, q) for (s, n), q in parts.items()) == want
        found += len(want)
    assert found > 30


@pytest.mark.parametrize("min_words, min_exp", [(2, 2), (10, 2), (24, 3), (5, 4), (200, 3)])
def test_other_bounds(monkeypatch, min_words, min_exp):
    monkeypatch.setattr(periodic, "DENSE", 0)
    for words in TEXTS[:25]:
        x = periodic.numbered([w.encode() for w in words])
        assert periodic.runs_of(x, min_words=min_words, min_exp=min_exp) == plain_runs(words, min_words, min_exp)


def test_ties_and_exact_exponents():
    a, b = [f"a{i}" for i in range(3)], [f"b{i}" for i in range(4)]
    words = a * 8 + ["x"] + b * 8 + ["y"] + a * 8
    got = periodic.result([w.encode() for w in words], periodic.runs_of(periodic.numbered([w.encode() for w in words])))
    assert got[1:5] == (0, 24, 3, 8000) and got[5] == plain(words)[5] and got[6] == "a0 a1 a2 x b0 b1 b2 b3 y a0 a1 a2"


@pytest.mark.parametrize("lags", [periodic.LAGS, 7])
def test_operator(spark, lags):
    texts = [None, "", " \n\t", "x " * 3000, *(random.Random(i).choice([" ", "  ", "\n"]).join(w) for i, w in enumerate(TEXTS))]
    rows = [(i, t, "own") for i, t in enumerate(texts)] + [(None, texts[3], "own")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("ranges", F.lit("own"))
    got = periodic.collapse_runs(docs, lags=lags).collect()
    assert len(got) == len(rows)
    want = {i: plain((t or "").split()) if i != 3 else (3000, 0, 3000, 1, 3000_000, [{"start": 0, "length": 3000, "period": 1}], "x") for i, t in enumerate(texts)}
    for r in got:
        assert (r.n_words, r.start, r.length, r.period, r.exponent_milli, [x.asDict() for x in r.runs], r.text) == want[3 if r.doc_id is None else r.doc_id]
    assert periodic.collapse_runs(docs.limit(0), lags=lags).count() == 0


def test_planted():
    for doc_id in range(400):
        text = " ".join(f"w{i}" for i in range(doc_id % 90))
        words = text.split()
        want = list(words)
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert queries.planted(doc_id, text.encode()) == [w.encode() for w in want]
    assert queries.planted(None, b"a b") == [b"a", b"b"]


def test_very_frequent_words():
    rng = np.random.default_rng(3)
    words = [str(w).encode() for w in rng.zipf(1.6, 6000) % 50]
    words[1000:2500] = words[1000:1500] * 3
    x = periodic.numbered(words)
    assert len(x) > periodic.DENSE and any(s <= 1000 and s + n >= 2500 and q == 500 for s, n, q in periodic.runs_of(x))
