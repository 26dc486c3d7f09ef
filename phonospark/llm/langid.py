"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of lower-cased words are hashed into a fixed number of features.
Document frequencies are counted over all training rows where they lie; each task sends one sparse
vector. The model is trained by follow-the-regularised-leader with elastic-net penalties, which leave more
than half of the features that occur without a weight, on a sample of at most about `sample` training rows.
A temperature is then fitted on rows of the sample that were held back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonospark.llm.common import cut, rows_of

#: The most labelled rows that the weights are fitted on, in expectation.
SAMPLE = 6_000
BITS, ORDERS = 15, (1, 2, 3)
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.4, 1e-4, 4
UNKNOWN = "und"
_SPREAD = np.uint32(2654435761)


def ngrams(text: str | None) -> np.ndarray:
    """Hashed n-grams of the whole text, one entry for each occurrence; none if it has no letter.

    Characters that aren't letters count as one space between words, so digits and signs say nothing.
    """
    if not text:
        return np.zeros(0, np.uint32)
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).copy()
    c[~_letters(c)] = 32
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    if len(c) == 1 and c[0] == 32 or not len(c):
        return np.zeros(0, np.uint32)
    c = np.concatenate(([np.uint32(32)], c[int(c[0] == 32) : len(c) - int(c[-1] == 32)], [np.uint32(32)])).astype(np.uint32)
    out = []
    for n in ORDERS:
        h = np.full(len(c) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ c[k : len(c) - n + 1 + k]) * _SPREAD
            h ^= h >> np.uint32(15)
        out.append(h[c[: len(h)] != 32] if n == 1 else h)
    return np.concatenate(out) & np.uint32((1 << BITS) - 1)


_table: list[np.ndarray] = []


def _letters(c: np.ndarray) -> np.ndarray:
    """Which code points are letters, by a table that is made once in a worker."""
    if not _table:
        _table.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _table[0][c]


def learnable(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (features + 1, languages), the last row being the intercept
    temperature: float = 1.0

    def logits(self, text: str | None) -> np.ndarray | None:
        """None where the text has no letter."""
        grams = ngrams(text)
        if not len(grams):
            return None
        at, x = tfidf(grams, self.idf)
        return x @ self.weights[at] + self.weights[-1]


def tfidf(grams: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and their weights, (1 + log tf) * idf, of length one."""
    n = np.bincount(grams, minlength=1 << BITS)
    at = np.flatnonzero(n)
    x = (1 + np.log(n[at])) * idf[at]
    return at, x / (np.sqrt((x * x).sum()) or 1.0)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Number of rows with each feature, and of all rows with a letter; summed in the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for _, (texts,) in rows_of(batches, "text"):
            for text in texts:
                grams = ngrams(text)
                if len(grams):
                    seen = np.zeros(1 << BITS, bool)
                    seen[grams] = True
                    df += seen
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << BITS).astype(np.int64)), pa.array(np.append(df[at], n))], names=["k", "n"])

    out = np.zeros((1 << BITS) + 1, np.int64)
    for r in rows.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # bounded: one row a feature
        out[r["k"]] = r["n"]
    return out[:-1], int(out[-1])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Per-coordinate FTRL-proximal with L1 and L2 over the rows, EPOCHS times, in a fixed random order."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) <= L1, 0.0, (np.sign(za) * L1 - za) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            at, x, y = rows[i]
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            was = n[at]
            now = was + g * g
            z[at] += g - (np.sqrt(now) - np.sqrt(was)) / ALPHA * w
            n[at] = now
    return weights(np.arange((1 << BITS) + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def shares(counts: dict[str, int], sample: int) -> dict[str, int]:
    """Of 2^62, the share of each language's rows that are learned from: equally many rows of each, all of a rare one."""
    out, left = {}, sample
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, left // (len(counts) - k))
        out[lang], left = (take << 62) // n, left - take
    return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from text and lang of rows whose crc32 of the id modulo 4 isn't 2; None without such rows."""
    train = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages, n = sorted(counts), sum(counts.values())
    df, total = document_frequencies(train)
    idf = np.log((1 + total) / (1 + df)) + 1
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (texts, langs, ids) in rows_of(batches, "text", "lang", "doc_id"):
            kept = [(i, lang, *np.unique(g, return_counts=True)) for t, lang, i in zip(texts, langs, ids) if len(g := ngrams(t))]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([number[k[1]] for k in kept], pa.int64()), pa.array([k[2].astype(np.int32) for k in kept], pa.list_(pa.int32())), pa.array([k[3].astype(np.int32) for k in kept], pa.list_(pa.int32()))], names=["doc_id", "y", "at", "n"])

    if n > sample:
        train = train.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 62)) < F.element_at(F.from_json(F.lit(json.dumps(shares(counts, sample))), "map<string,bigint>"), F.col("lang")))
    rows = sorted(train.mapInArrow(run, "doc_id long, y long, at array<int>, n array<int>").collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["y"], r["at"]))
    data = [(*tfidf(np.repeat(r["at"], r["n"]), idf), r["y"]) for r in rows]
    held = [d for i, d in enumerate(data) if i % 10 == 9]
    weights = ftrl([d for i, d in enumerate(data) if i % 10 != 9], len(languages))
    logits = np.array([x @ weights[at] + weights[-1] for at, x, _ in held]).reshape(-1, len(languages))
    return Model(languages, idf, weights, temperature(logits, np.array([y for _, _, y in held], dtype=int)))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs, read from its whole text.

    lang_pred is `und` with score 1 for texts that are null or have no letter, and `und` with score 0
    where nothing could be learned (no rows to learn from, or no rows at all). Ties go to the first language
    by name. lang, source and doc_id are no inputs; held_out (crc32 of the id modulo 4 is 2) is false for a
    null id. Texts are read whole, however long; repeated rows are scored and taught each; columns of docs
    other than doc_id, text and lang aren't read, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part, (texts,) in rows_of(batches, "text"):
            names, scores = [], []
            for text in texts:
                z = model.logits(text) if model else None
                if z is None:
                    blank = not len(ngrams(text))
                    names.append(UNKNOWN)
                    scores.append(1.0 if blank else 0.0)
                else:
                    p = softmax(z / model.temperature)
                    names.append(model.languages[int(p.argmax())])
                    scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
