"""The FM-index and substring deduplication against plain versions."""

import random

import numpy as np
import pytest

from phonospark.llm import substring
from phonospark.llm.fmindex import Bits, FMIndex, WaveletTree, sorted_suffixes


def test_bits():
    bits = np.random.default_rng(1).random(1000) < 0.3
    for n in (1, 63, 64, 65, 128, 1000):
        assert Bits(bits[:n]).ones(np.arange(n + 1)).tolist() == [int(bits[:i].sum()) for i in range(n + 1)]


@pytest.mark.parametrize("k", [1, 2, 3, 50])
def test_wavelet_tree(k):
    rng = np.random.default_rng(k)
    seq = np.sort(rng.zipf(1.5, 600) % k)
    _, seq = np.unique(seq, return_inverse=True)
    by = np.argsort(-np.bincount(seq), kind="stable")
    number = np.empty(len(by), np.int64)
    number[by] = np.arange(len(by))
    seq = number[seq]
    rng.shuffle(seq)
    tree = WaveletTree(seq)
    entropy = -sum(p * np.log2(p) for p in np.bincount(seq) / len(seq))
    assert (tree.size[seq]).mean() <= entropy + 1
    s, at = np.meshgrid(np.arange(len(by)), np.arange(len(seq) + 1))
    s, at = s.ravel(), at.ravel()
    assert tree.count(s, at).tolist() == [int((seq[:i] == x).sum()) for x, i in zip(s, at)]


@pytest.mark.parametrize("kinds, n", [(1, 40), (2, 200), (5, 300), (200, 300)])
def test_matching_statistics(kinds, n):
    rng = np.random.default_rng(n)
    text = rng.integers(0, kinds, n)
    _, text = np.unique(text, return_inverse=True)
    text = np.append(text, text.max() + 1)
    order = sorted_suffixes(text, 8)
    cut = [tuple(text[i : i + 8]) for i in order]
    assert cut == sorted(cut) and sorted(order) == list(range(n + 1))
    got = FMIndex(text, 8).matching_statistics(text, np.arange(n))

    def longest(e):
        best = 0
        for m in range(1, min(8, e + 1) + 1):
            s = tuple(text[e + 1 - m : e + 1])
            if sum(tuple(text[i : i + m]) == s for i in range(n - m + 1)) < 2:
                break
            best = m
        return best

    assert got.tolist() == [longest(e) for e in range(n)]


def plain(texts, length):
    """(kept, words, removed) of each text, by all windows."""
    words = [[w.decode() for w in (t or "").encode().split()] for t in texts]
    times = {}
    for own in words:
        for i in range(len(own) - length + 1):
            times[tuple(own[i : i + length])] = times.get(tuple(own[i : i + length]), 0) + 1
    out = []
    for own in words:
        gone = [False] * len(own)
        for i in range(len(own) - length + 1):
            if times[tuple(own[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        left = [w for w, g in zip(own, gone) if not g]
        out.append((" ".join(left), len(own), len(own) - len(left)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda k: f"w{rng.randrange(k)}é"
    passages = [[word(300) for _ in range(rng.choice([34, 35, 36, 60, 150]))] for _ in range(6)]
    texts = [None, "", " \t\n", "x " * 200, "a b " * 90 + "\x0b\x0cend", "a b c " * 60]
    for _ in range(60):
        own = [word(300) for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            at = rng.randrange(len(own) + 1)
            own[at:at] = p[a:] if rng.random() < 0.5 else p
        if rng.random() < 0.3 and own:
            own[rng.randrange(len(own))] = "edit"
        texts.append(rng.choice([" ", "  ", "\n"]).join(own))
    return texts + texts[-5:]


@pytest.mark.parametrize("seed, shard, most", [(1, 8000, 8000), (2, 5, 8000), (3, 8000, 2), (4, 3, 0)])
def test_equals_all_windows(spark, seed, shard, most):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.n_words, r.n_removed) for r in substring.remove_repeated(docs, shard=shard, most=most).collect()}
    want = plain(texts, substring.LENGTH)
    assert got == dict(enumerate(want))
    assert sum(x[2] for x in want) > 500


def test_many_contexts_of_one_anchor(spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(20)]
    texts = [" ".join([f"l{rng.randrange(9)}" for _ in range(14 + i % 3)] + common + [f"r{rng.randrange(9)}" for _ in range(30)]) for i in range(300)]
    texts += [" ".join(t.split()[:-3]) for t in texts[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(plain(texts, substring.LENGTH)))
    for most in (8000, 50):
        got = {r.doc_id: (r.kept, r.n_words, r.n_removed) for r in substring.remove_repeated(docs, most=most).collect()}
        assert got == want


def test_texts_in_pieces(monkeypatch, spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(900))]
    texts += [texts[0][100:-300], texts[0].replace("w7 ", "v7 ")]
    whole = [substring.contexts(t.encode().split()) for t in texts]
    monkeypatch.setattr(substring, "PIECE", 64)
    for t, (_, lo, hi) in zip(texts, whole):
        _, x, y = substring.contexts(t.encode().split())
        spans = lambda a, b: [s for u, v in zip(a, b) for s in range(u, v - 34)]
        assert spans(x, y) == spans(lo, hi) == list(range(len(t.split()) - 34))


def test_spans_and_edges(spark):
    p = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"a {p} b {p}"), (None, f"{p} c"), (None, f"{p} c"), (4, None)]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, d string, lo int")
    got = sorted(map(tuple, substring.remove_repeated(docs).collect()), key=str)
    assert got == [(1, "a b", 82, 80, 2), (4, "", 0, 0, 0), (None, "", 41, 41, 1), (None, "", 41, 41, 1)]
    assert substring.remove_repeated(docs.limit(0)).count() == 0
