"""Language, toxicity and the pipeline's stages against plain versions."""

import math
import random

import corpus_pipeline as cp
import numpy as np
import pytest

from phonospark.llm import decontam, langid, line_dedup, toxicity

SPREAD = 2654435761


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return []
    s, out = " " + " ".join(words) + " ", []
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            if n == 1 and s[i] == " ":
                continue
            h = n
            for c in s[i : i + n]:
                h = (h ^ ord(c)) * SPREAD % 2**32
                h ^= h >> 15
            out.append(h % 2**langid.BITS)
    return out


def plain_weights(text, idf):
    grams = plain_grams(text)
    tf = {g: (1 + math.log(grams.count(g))) * idf[g] for g in grams}
    norm = math.sqrt(sum(v * v for v in tf.values()))
    return {g: v / norm for g, v in tf.items()}


def test_grams():
    for text in ("Ein Fuß, zwei Füße", "a", "12 34", "", "\U00030001 x\U00030001", "é́ ʰ ٣", " . b"):
        assert sorted(langid.ngrams(text).tolist()) == sorted(plain_grams(text))
    assert len(langid.ngrams(None)) == 0


@pytest.mark.parametrize("penalty", [1e-3, 0.1, langid.L1])
def test_regression_equals_a_plain_one(monkeypatch, penalty):
    monkeypatch.setattr(langid, "L1", penalty)
    rng = random.Random(4)
    texts = [("".join(rng.choice(a) for _ in range(12)), y) for y, a in enumerate(("abc ", "bcd ", "xyz ")) for _ in range(4)]
    texts = [(t, y) for t, y in texts if t.strip()]
    idf = {g: 1 + 0.1 * (g % 7) for t, _ in texts for g in plain_grams(t)}
    full = np.zeros(1 << langid.BITS)
    for g, v in idf.items():
        full[g] = v
    data = []
    for t, y in texts:
        at, x = langid.tfidf(langid.ngrams(t), full)
        want = plain_weights(t, idf)
        assert dict(zip(at.tolist(), x.tolist())) == pytest.approx(want)
        data.append((at, x, y))
    got = langid.ftrl(data, 3)
    z, n = {}, {}
    last = 1 << langid.BITS

    def weight(g, k):
        v = z.get((g, k), 0.0)
        return 0.0 if abs(v) <= langid.L1 else (math.copysign(langid.L1, v) - v) / ((langid.BETA + math.sqrt(n.get((g, k), 0.0))) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(5)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(len(data)).tolist():
            x = {**plain_weights(texts[i][0], idf), last: 1.0}
            logits = [sum(v * weight(g, k) for g, v in x.items()) for k in range(3)]
            e = [math.exp(v - max(logits)) for v in logits]
            steps = [(g, k, v * (e[k] / sum(e) - (k == texts[i][1])), weight(g, k)) for g, v in x.items() for k in range(3)]
            for g, k, d, w in steps:
                was = n.get((g, k), 0.0)
                n[g, k] = was + d * d
                z[g, k] = z.get((g, k), 0.0) + d - (math.sqrt(n[g, k]) - math.sqrt(was)) / langid.ALPHA * w
    want = np.array([[weight(g, k) for k in range(3)] for g in [*idf, last]])
    assert got[[*idf, last]] == pytest.approx(want, abs=1e-9) and (want == 0).any() == (penalty >= 0.1)


def test_temperature_is_the_best():
    rng = np.random.default_rng(1)
    logits, y = rng.standard_normal((400, 3)) * 4, rng.integers(0, 3, 400)
    y[:300] = logits[:300].argmax(1)
    loss = lambda t: -np.log(langid.softmax(logits / t)[np.arange(400), y]).mean()
    best = langid.temperature(logits, y)
    assert loss(best) <= min(loss(t) for t in np.exp(np.linspace(-3, 3, 400))) + 1e-6


def test_calibration_and_accuracy_at_scale(spark):
    sf = "/root/testdata/sf0.1"
    got = langid.identify(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out")
    rows = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    right = np.array([r.lang == r.lang_pred for r in rows])
    score = np.array([r.score for r in rows])
    assert right.mean() > 0.99 and abs(score.mean() - right.mean()) < 0.03


# --- toxicity


def plain_features(classes):
    """Counts by looking back from each match within its clause."""
    T = toxicity
    counts, clauses, clause = dict.fromkeys(T.PATTERNS, 0), 0, []
    for c in [*classes, T.END]:
        if c != T.END:
            clause.append(c)
            continue
        found = False
        for i, w in enumerate(clause):
            if w in (T.INSULT, T.THREAT):
                found = True
                counts["insult" if w == T.INSULT else "threat", int(T.TARGET in clause[max(0, i - 4) : i]), int(T.NEGATION in clause[max(0, i - 3) : i]), int(T.REPORT in clause[:i])] += 1
        clauses, clause = clauses + found, []
    return [*np.log1p([counts[p] for p in T.PATTERNS]), np.log1p(clauses)]


def test_machine_equals_looking_back():
    rng, g = random.Random(2), toxicity.Grammar()
    for _ in range(400):
        classes = rng.choices(range(7), (8, 2, 2, 2, 2, 1, 1), k=rng.randrange(60))
        assert g.features(classes) == pytest.approx(plain_features(classes))


def test_regression_is_at_its_optimum():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 4))
    y = (x[:, 0] + rng.standard_normal(300) > 0).astype(float)
    w = toxicity.regress(x, y)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (y - p) - w[:-1]).max() < 1e-6 and abs((y - p).sum()) < 1e-4


# --- stages


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def held(df):
    return sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())


def test_toxicity_stage(spark, docs, sf):
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    read = toxicity.Reader(model.words, model.stems)
    clean = lambda t: np.dot(plain_features(read(t)), model.weights[:-1]) + model.weights[-1] < 0
    assert held(cp.drop_toxic(spark, docs, sf)) == [(i, t) for i, t in held(docs) if clean(t)]


def test_line_stage(spark, docs, sf):
    owners, rows = {}, held(docs)
    lower = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\v\f\r"))
    for i, t in rows:
        for x in t.split("\n"):
            if len(lower(x)) >= 20:
                owners.setdefault(lower(x), set()).add(i)
    gone = lambda i, x: len(own := owners.get(lower(x), ())) >= 3 and i != max(own)
    want = sorted((i, "\n".join(x for x in t.split("\n") if not gone(i, x))) for i, t in rows)
    assert held(cp.drop_repeated_lines(spark, docs, sf)) == want != rows


def test_filters_in_shards_find_the_same(spark, docs):
    keys = line_dedup.repeated(line_dedup.references(docs))
    filters = line_dedup.build_filters(keys, 5)
    one = line_dedup.drop_lines(docs, keys, filters, 5)
    two = line_dedup.drop_lines(docs, keys, filters, 5, broadcast_bytes=0)
    assert held(one) == held(two) != held(docs)
    hits = line_dedup.in_shards(line_dedup.references(docs), filters, 5)
    want = line_dedup.references(docs).join(keys, ["hi", "lo"], "left_semi")
    assert want.join(hits, ["hi", "lo"], "left_anti").count() == 0 and hits.count() < 1.1 * want.count() + 10


def test_state_counts_only_keys_of_the_change(spark, docs, monkeypatch):
    state = line_dedup.LineDedup.empty(spark, 3).insert(docs)
    few = docs.where("doc_id < 5")
    change = {(r.hi, r.lo) for r in line_dedup.references(few).collect()}
    seen, old = [], line_dedup.counted
    monkeypatch.setattr(line_dedup, "counted", lambda refs: seen.extend(refs.select("hi", "lo").collect()) or old(refs))
    again = state.insert(few)  # is there already
    assert not seen and held(again.apply(docs)) == held(state.apply(docs))
    less = state.delete(few.select("doc_id"))
    assert seen and {(r.hi, r.lo) for r in seen} <= change
    monkeypatch.undo()
    rest = docs.where("doc_id >= 5")
    assert held(less.apply(rest)) == held(line_dedup.dedup_lines(rest))
    assert held(less.insert(few).apply(docs)) == held(line_dedup.dedup_lines(docs))


def test_decontamination_stage(spark, docs, sf):
    items = [decontam.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def covered(doc, item):
        d, t, total = list(doc), list(item), 0
        while True:
            best = (0, 0, 0)
            for j in range(len(d)):
                for i in range(len(t)):
                    n = 0
                    while j + n < len(d) and i + n < len(t) and d[j + n] == t[i + n] is not None:
                        n += 1
                    best = max(best, (n, -j, -i))
            n, j, i = best[0], -best[1], -best[2]
            if n < 5:
                return total
            d[j : j + n], t[i : i + n], total = [None] * n, [0] * n, total + n

    def near(doc, item):
        """The words of doc around runs of five words that item has too."""
        seeds = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}
        use = {k for j in range(len(doc) - 4) if tuple(doc[j : j + 5]) in seeds for k in range(j, j + 5)}
        return [doc[k] if k in use else -1 for k in range(len(doc))] if use else []

    bad = lambda t: any(covered([x for x in near(w, i)], i) >= 0.8 * len(i) for i in items if len(i) >= 5 and near(w := decontam.words_of(t), i))
    small = docs.where("length(coalesce(text, '')) < 3000")
    assert held(cp.drop_contaminated(spark, small, sf)) == [(i, t) for i, t in held(small) if not bad(t)] != held(small)


@pytest.mark.parametrize("n", [1, 7_000, 10**7, 10**11, 10**14])
def test_samples_never_come_to_nothing(n):
    """Shares of 2^62: rows of a rare language are all taken, of others about as many of each, however many there are."""
    got = langid.shares({"a": n, "b": 3 * n, "rare": 2}, langid.SAMPLE)
    rows = {k: v * got[k] / 2**62 for k, v in {"a": n, "b": 3 * n, "rare": 2}.items()}
    assert rows["rare"] == 2 and sum(rows.values()) <= langid.SAMPLE + 1e-6
    assert all(v > 0 for v in got.values()) and rows["a"] >= min(n, langid.SAMPLE // 3 - 1) - 1e-6
    assert (toxicity.SAMPLE << 62) // max(n, toxicity.SAMPLE + 1) > 0


def test_language_model_is_sparse(spark, sf):
    """Under half of the features that occur keep a weight, and held-out languages are still told."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train = docs.where(langid.learnable(docs.doc_id) & docs.lang.isNotNull() & docs.text.isNotNull())
    df, _ = langid.document_frequencies(train)
    model = langid.fit(docs)
    kept = (model.weights[:-1] != 0).any(1)
    assert 50 < kept.sum() < 0.5 * (df > 0).sum() and not kept[df == 0].any()
    told = {r.doc_id: r.lang_pred for r in langid.identify(docs).where("held_out").collect()}
    held = {r.doc_id: r.lang for r in docs.where(~langid.learnable(docs.doc_id)).collect() if r.lang is not None and told[r.doc_id] != langid.UNKNOWN}
    assert sum(told[i] == lang for i, lang in held.items()) >= 0.97 * len(held)
