"""Toxicity by a weighted finite-state pattern grammar.

Words are read as classes: insult, threat, target, negation, reported speech, clause end, other. Small
transducers each follow one of these through a clause; they are composed into one machine whose output
at an insult or threat says how it stands there: aimed at a target, negated, reported. A clause's
matches are counted by pattern, and the patterns' weights make the document's score.

What the grammar can't know is learned from labelled rows: the insult lexicon (words, and stems where
a language inflects them), and the patterns' weights by logistic regression. Learning takes a sample of
at most about `sample` labelled rows, drawn by a hash of the id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonospark.llm.common import cut, rows_of

#: The most labelled rows that learning takes, in expectation.
SAMPLE = 20_000
#: A learned word or stem: least share of toxic rows (and number) with it, most of its rows that are clean.
MIN_SHARE, MIN_ROWS, MAX_CLEAN = 0.005, 5, 0.02
STEMS = (4, 5, 6, 7, 8)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
# The grammar's own words.
LEXICON = {
    INSULT: "idiot idiots moron morons stupid loser losers scum worthless pathetic disgusting trash imbecile dumb bastard idiota estupido estúpido imbécil idiote crétin connard dummkopf blödmann abschaum",
    THREAT: "kill murder destroy hurt strangle tue töte umbringen tuer mataré matar",
    TARGET: "you your you're u he she they them this these those tu te vous toi du dich euch ihr usted ustedes ti",
    NEGATION: "not no never isn't aren't n't nicht kein keine nie pas jamais nunca jamás",
    REPORT: "said says say told called claims wrote quote quoted sagte sagt nannte dit disait écrit dijo dice escribió",
}
TOKEN = re.compile(r"[\w']+|[.!?;:\n]+")


@dataclass(frozen=True)
class Transducer:
    """start state; arcs (state, class) -> (state, output tuple). Missing arcs keep the state and say nothing."""

    start: tuple
    classes: tuple = tuple(range(6))
    arcs: dict = field(default_factory=dict)

    def step(self, state: tuple, c: int) -> tuple[tuple, tuple]:
        return self.arcs.get((state, c), (state, ()))

    def states(self) -> set:
        return {self.start} | {s for s, _ in self.arcs} | {s for s, _ in self.arcs.values()}


def scope(name: str, opens: int, reach: int) -> Transducer:
    """Says `name` for `reach` words after a word of class `opens` (reach 0: to the clause's end)."""
    arcs = {}
    for left in range(reach + 1 if reach else 2):
        for c in range(6):
            to = (reach or 1) if c == opens else left if not reach else max(0, left - 1)
            arcs[(left,), c] = ((to,), (name,) if left else ())
    return Transducer((0,), arcs=arcs)


def trigger() -> Transducer:
    return Transducer(("-",), arcs={(("-",), INSULT): (("-",), ("insult",)), (("-",), THREAT): (("-",), ("threat",))})


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read the same words; states are pairs, outputs are joined. Only reachable states are made."""
    start = a.start + b.start
    cut_at, arcs, todo = len(a.start), {}, [start]
    seen = {start}
    while todo:
        s = todo.pop()
        for c in range(6):
            (x, out_a), (y, out_b) = a.step(s[:cut_at], c), b.step(s[cut_at:], c)
            arcs[s, c] = (x + y, out_a + out_b)
            if x + y not in seen:
                seen.add(x + y)
                todo.append(x + y)
    return Transducer(start, arcs=arcs)


PATTERNS = [(kind, aimed, negated, reported) for kind in ("insult", "threat") for aimed in (0, 1) for negated in (0, 1) for reported in (0, 1)]


class Grammar:
    """The composed machine as tables: next state and pattern (or -1) by state and class."""

    def __init__(self) -> None:
        m = compose(compose(compose(trigger(), scope("target", TARGET, 4)), scope("negated", NEGATION, 3)), scope("reported", REPORT, 0))
        states = sorted(m.states(), key=str)
        number = {s: i for i, s in enumerate(states)}
        self.start = number[m.start]
        self.next = [[number[m.step(s, c)[0]] for c in range(6)] for s in states]
        self.out = [[self._pattern(m.step(s, c)[1]) for c in range(6)] for s in states]

    @staticmethod
    def _pattern(out: tuple) -> int:
        kind = [x for x in out if x in ("insult", "threat")]
        return PATTERNS.index((kind[0], int("target" in out), int("negated" in out), int("reported" in out))) if kind else -1

    def features(self, classes: list[int]) -> list[float]:
        """Log counts of matches by pattern, and of clauses with a match."""
        counts, clauses, state, matched = [0] * len(PATTERNS), 0, self.start, False
        for c in classes:
            if c == END:
                clauses, state, matched = clauses + matched, self.start, False
                continue
            if (p := self.out[state][c]) >= 0:
                counts[p] += 1
                matched = True
            state = self.next[state][c]
        return [*np.log1p(counts).tolist(), float(np.log1p(clauses + matched))]


class Reader:
    """Tokens to classes, by the fixed words and the learned words and stems."""

    def __init__(self, words: set[str], stems: set[str]) -> None:
        self.fixed = {w: c for c, ws in LEXICON.items() for w in ws.split()}
        self.words, self.stems, self.cache = words, stems, {}

    def _class(self, w: str) -> int:
        if w[0] in ".!?;:\n":
            return END
        if w in self.fixed:
            return self.fixed[w]
        return INSULT if w in self.words or any(w[:n] in self.stems for n in STEMS if len(w) >= n) else OTHER

    def __call__(self, text: str | None) -> list[int]:
        tokens = TOKEN.findall(text.lower()) if text else []
        got = list(map(self.cache.get, tokens))
        if None in got:
            if len(self.cache) > 300_000:
                self.cache.clear()
            for i, (g, w) in enumerate(zip(got, tokens)):
                if g is None:
                    got[i] = self.cache[w] = self._class(w)
        return got


def parts_of(text: str) -> set[str]:
    """A document's candidates for the lexicon: words, and stems marked with an asterisk."""
    words = {w for w in TOKEN.findall(text.lower()) if w[0] not in ".!?;:\n"}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def one_minhash(text: str) -> int:
    """Equal for most near copies; support counts it once, so copies of one text don't make a lexicon."""
    words = text.lower().split()
    return min((xxhash.xxh32_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0)


def learnable(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


@dataclass
class Model:
    words: set[str]
    stems: set[str]
    weights: np.ndarray


#: Where no labels can be learned from: every match speaks for toxicity, less so negated or reported.
PRIOR = np.array([*(2.0 * (0.4 if negated else 1) * (0.5 if reported else 1) * (1.3 if aimed else 1) for _, aimed, negated, reported in PATTERNS), 0.5, -2.0])


def taught(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic, mh): the labelled rows to learn from, about `sample` at most, with a min-hash.

    An id counts once: several labels of it are toxic if one is, and of several texts the least is taken.
    A label other than 0 is toxic, a null one is none. The sampled ids are few by the bound on `sample`, so
    they are broadcast and texts stay where they are.
    """
    y = labels.where(F.col("toxic").isNotNull() & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    n = y.count()
    if n > sample:
        y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) < (sample << 62) // n)
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (texts,) in rows_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(one_minhash, texts), pa.int64())], names=["text", "toxic", "mh"])

    return found.select("text", "toxic").mapInArrow(run, "text string, toxic int, mh long")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows of labels (doc_id, toxic) whose crc32 of the id isn't divisible by 5."""
    rows = cut(taught(docs, labels, sample))
    apart = cut(rows.groupBy("toxic", "mh").agg(F.min("text").alias("text")))  # one of each set of near copies

    def gather(only: set[str] | None, toxic: int) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(only)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: Counter = Counter()
            keep = sent.value
            for _, (texts,) in rows_of(batches, "text"):
                for text in texts:
                    held.update(parts_of(text) if keep is None else parts_of(text) & keep)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["part", "n"])

        return apart.where(F.col("toxic") == toxic).select("text").mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))

    have = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(have) < 2:
        return Model(set(), set(), PRIOR)
    least = max(MIN_ROWS, MIN_SHARE * have[1])
    hot = {r["part"]: r["n"] for r in gather(None, 1).where(F.col("n") >= least).collect()}
    clean = {r["part"]: r["n"] for r in gather(set(hot), 0).collect()}
    lexicon = {p for p, k in hot.items() if clean.get(p, 0) <= MAX_CLEAN * k}
    model = Model({p for p in lexicon if p[-1] != "*"}, {p[:-1] for p in lexicon if p[-1] == "*"}, PRIOR)
    x = sorted((r["f"], r["toxic"]) for r in features(rows, model).collect())  # bounded by the sample
    model.weights = regress(np.array([f for f, _ in x]), np.array([y for _, y in x], float))
    return model


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept and isn't shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def features(docs: DataFrame, model: Model) -> DataFrame:
    """(toxic, f array<double>) of docs (text, toxic): what the grammar finds in each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(sent.value)
        for part, (texts,) in rows_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(map(find, texts), pa.list_(pa.float64()))], names=["toxic", "f"])

    return docs.select("text", "toxic").mapInArrow(run, "toxic int, f array<double>")


class Finder:
    """A model made ready in a task: a text's features, and its score."""

    def __init__(self, model: Model) -> None:
        self.read, self.grammar, self.weights = Reader(model.words, model.stems), Grammar(), model.weights
        self.none = self.grammar.features([])

    def __call__(self, text: str | None) -> list[float]:
        classes = self.read(text)
        return self.grammar.features(classes) if INSULT in classes or THREAT in classes else self.none

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(np.dot(self(text), self.weights[:-1]) + self.weights[-1]))))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; null and empty texts match nothing.

    held_out marks rows whose crc32 of the id is divisible by 5; they never teach. A null doc_id is
    scored, and held_out is false for it. With no labels of one kind, fixed weights are used; no rows give
    no rows. Texts are read whole, however long; repeated rows are scored each and taught once. Columns of
    docs other than doc_id and text aren't read, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(sent.value)
        for part, (texts,) in rows_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(find.score, texts), pa.float64())], names=["doc_id", "held_out", "score"])

    held = F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out")
    out = docs.select("doc_id", held, "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs, with all their columns, without the rows whose own text scores 0.5 or more, whatever their doc_id."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(sent.value)
        for part, (texts,) in rows_of(batches, "text"):
            yield part.filter(pa.array([find.score(t) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
