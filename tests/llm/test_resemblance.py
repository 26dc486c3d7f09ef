"""The pipeline's near-duplicate stage on planted pairs and on rows with null and repeated ids."""

import random

import corpus_pipeline as cp
import pytest

from phonospark.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def body(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def rows(pairs):
    return [(i, t, "en", "x", None if t is None else len(t)) for i, t in pairs]


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """Pairs at 0.8 to 0.95, others just below, and texts of their own."""
    rng, out, want = random.Random(3), [], {}
    for k in range(60):
        n = rng.randrange(120, 400)
        a = body(rng, n)
        new = round((n - 4) * (1 - (want_j := 0.75 + 0.2 * k / 59)) / (1 + want_j))
        b = a[: n - new] + body(rng, new)
        out += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want[k] = jaccard(shingle_set(out[-2][1]), shingle_set(out[-1][1])) >= 0.8
    return out, want


def test_planted_pairs(spark):
    docs, want = planted()
    assert 10 < sum(want.values()) < 60
    kept = {r.doc_id for r in cp.drop_near_duplicates(spark, spark.createDataFrame(rows(docs), DOCS), "").collect()}
    assert kept == {2 * k for k in want} | {2 * k + 1 for k, near in want.items() if not near}


@pytest.mark.parametrize("sent", [simhash.BROADCAST_BYTES, 0])
def test_brute_force_on_a_large_group(spark, monkeypatch, sent):
    """Many edited copies of one text that differ among each other by up to 0.6; sets broadcast, and joined."""
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", sent)
    rng = random.Random(5)
    base = body(rng, 200)
    docs = []
    for i in range(80):
        t = list(base)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(t)))
    sets = [shingle_set(t) for _, t in docs]
    low = list(range(80))
    while True:
        new = [min(low[j] for j in range(80) if jaccard(sets[i], sets[j]) >= 0.8) for i in range(80)]
        if new == low:
            break
        low = new
    kept = {r.doc_id for r in cp.drop_near_duplicates(spark, spark.createDataFrame(rows(docs), DOCS), "").collect()}
    assert 1 < len(set(low)) < 80 and kept == set(low)


def test_rows_with_null_and_repeated_ids(spark):
    rng = random.Random(7)
    a, b, c, d = (" ".join(body(rng, 50)) for _ in range(4))
    docs = [(7, a), (7, b), (3, b), (None, c), (None, c), (8, c), (9, d), (9, d), (None, d), (4, None), (5, ""), (None, " \n"), (None, a + " z")]
    got = sorted((r.doc_id, r.text or "") for r in cp.drop_near_duplicates(spark, spark.createDataFrame(rows(docs), DOCS), "").collect())
    assert got == sorted([(7, a), (3, b), (8, c), (9, d), (4, "")])
    twins = spark.createDataFrame(rows([(None, a), (None, a)]), DOCS)
    assert [r.text for r in cp.drop_near_duplicates(spark, twins, "").collect()] == [a]
    assert cp.drop_near_duplicates(spark, twins.limit(0), "").count() == 0


def test_brute_force_on_documents(spark, sf):
    """Whatever the stage keeps of the smallest documents is what brute force keeps."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = [(r.doc_id, shingle_set(r.text)) for r in docs.select("doc_id", "text").collect()]
    ids = [i for i, _ in held]
    close = {(i, j) for x, (i, a) in enumerate(held) for j, b in held[:x] if jaccard(a, b) >= 0.8}
    low = {i: i for i in ids}
    for _ in range(len(ids)):
        old = dict(low)
        for i, j in close:
            low[i] = low[j] = min(low[i], low[j])
        if low == old:
            break
    assert {r.doc_id for r in cp.drop_near_duplicates(spark, docs, sf).collect()} == set(low.values())


@pytest.mark.parametrize("short, long", [(5, 5), (8, 9), (12, 14), (16, 19), (24, 29), (34, 41)])
def test_short_texts(spark, short, long):
    """Pairs at 0.8, the least index: the longer text goes on for some words."""
    rng = random.Random(short)
    pairs = []
    for k in range(250):
        words = [f"w{rng.randrange(10**9)}" for _ in range(long)]
        pairs += [(2 * k, " ".join(words[:short])), (2 * k + 1, " ".join(words).upper() if k % 2 else " ".join(words))]
    assert jaccard(shingle_set(pairs[0][1]), shingle_set(pairs[1][1].lower())) >= 0.8
    kept = simhash.drop_near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).count()
    assert 500 - kept >= 0.96 * 250
