"""Runs of periodic words: every lag of a text is compared, true stretches are run-length coded.

A text's words are numbered. Against its copy shifted by a lag, places that agree for long enough are a run
whose period is the lag. All lags up to n / min_exp are looked at: blocks of lags are compared with the text
in one step each. A stretch of m agreeing places holds two neighbours among every (m // 2)-th place, so of a
long text only lags where two such neighbours agree are compared in full; no lag with a run is passed over.

Texts of up to `lags` lags are done where they lie. Longer ones are dealt by ranges of lags to many tasks,
and their runs are put together by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonospark.llm.common import rows_of, text_bytes

MIN_WORDS, MIN_EXP = 24, 3
#: Lags that one task takes of a text, and the most ranges that a text is dealt in.
LAGS, RANGES = 1 << 18, 64
#: Places that are compared in one step; texts of so many words or fewer are compared at all lags in full.
BLOCK, DENSE = 1 << 17, 1024

Run = tuple[int, int, int]


def split_words(doc_id: int | None, text: bytes) -> list[bytes]:
    """What lies between ASCII white space."""
    return text.split()


def numbered(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    return np.array(ids, np.uint16 if len(number) < 1 << 16 else np.int32)


def least(q: int, min_words: int, min_exp: int) -> int:
    """Agreeing places in a row that make a run of period q."""
    return max(min_words - q, (min_exp - 1) * q, 1)


def promising(x: np.ndarray, lo: int, hi: int, min_words: int, min_exp: int) -> list[int]:
    """Lags from lo up to hi at which two neighbours of the sampled places agree."""
    out = []
    for q in range(lo, hi):
        m = least(q, min_words, min_exp)
        step = max(1, m // 2)
        same = x[: len(x) - q : step] == x[q::step]
        if m < 2 or same.tobytes().find(b"\1\1") >= 0:
            out.append(q)
    return out


def compared(x: np.ndarray, lags: np.ndarray, min_words: int, min_exp: int) -> Iterator[Run]:
    """(start, length, lag) of the stretches that are long enough, by lag."""
    n = len(x)
    if not len(lags):
        return
    wide = x.astype(np.int64)
    shifted = sliding_window_view(np.concatenate((wide, np.full(int(lags[-1]), -1))), n)
    need = np.array([least(int(q), min_words, min_exp) for q in lags])
    rows = max(1, BLOCK // n)
    for at in range(0, len(lags), rows):
        own = lags[at : at + rows]
        whole = len(own) == own[-1] - own[0] + 1
        same = (shifted[own[0] : own[-1] + 1] if whole else shifted[own]) == wide
        place = np.flatnonzero(same.ravel())  # a row's last place never agrees, so no stretch crosses rows
        if not len(place):
            continue
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1] + 1)))
        size = np.diff(np.append(first, len(place)))
        row = place[first] // n
        for k in np.flatnonzero(size >= need[at + row]).tolist():
            q = int(own[row[k]])
            yield int(place[first[k]] % n), int(size[k]) + q, q


def runs_of(x: np.ndarray, lo: int = 1, hi: int | None = None, min_words: int = MIN_WORDS, min_exp: int = MIN_EXP) -> list[Run]:
    """(start, length, period) at the lags from lo up to hi, each stretch with its least lag.

    A stretch of a period that is also one of a multiple is the same stretch at both lags, as it is at least
    as long as their sum.
    """
    hi = min(len(x) // min_exp + 1, hi if hi is not None else len(x))
    lags = range(lo, hi) if len(x) <= DENSE else promising(x, lo, hi, min_words, min_exp)
    best: dict[tuple[int, int], int] = {}
    for start, length, q in compared(x, np.array(lags, np.int64), min_words, min_exp):
        best.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in best.items())


NAMES = ["doc_id", "n_words", "start", "length", "period", "exponent_milli", "runs", "text"]
RUN = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = f"doc_id long, n_words long, start long, length long, period long, exponent_milli long, runs array<{RUN}>, text string"
_RUNS = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    return b" ".join([w for w, c in zip(words, np.cumsum(change).tolist()) if not c])


def result(words: list[bytes], runs: list[Run]) -> tuple:
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    found = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(words), *found, [dict(zip(("start", "length", "period"), r)) for r in runs], collapsed(words, runs).decode("utf-8", "replace")


def _batch(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [_RUNS, pa.string()]
    return pa.RecordBatch.from_arrays([doc_ids, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=NAMES)


def collapse_runs(docs: DataFrame, words: Callable[[int | None, bytes], list[bytes]] = split_words, min_words: int = MIN_WORDS, min_exp: int = MIN_EXP, lags: int = LAGS) -> DataFrame:
    """(doc_id, n_words, start, length, period, exponent_milli, runs, text) for each row of docs.

    A run is a stretch of words of smallest period q, of at least min_words words and min_exp periods, that
    can't be extended; min_exp is 2 at least. runs has all, by start, then period; start, length, period and
    exponent_milli are of the one of most periods (ties: the smallest start, then period), null where there is
    none. text are the words that no run holds after its first period, joined by one space. `words` gives a
    row's words from doc_id and text, no more than the text's bytes can hold.

    Null and empty texts have no words and no runs. Repeated rows give equal rows, no rows give none, doc_id
    may be null. Texts are read whole, in ranges of lags where they are very long. Columns of docs other than
    doc_id and text aren't read, whatever their names.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    most = F.ceil((F.octet_length("text") + 1) / 2 / min_exp / lags)
    base = base.withColumn("ranges", F.greatest(F.lit(1), F.least(F.lit(RANGES), most)).cast("int"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (doc_ids, texts) in rows_of(batches, "doc_id", "text"):
            own = [words(i, t) for i, t in zip(doc_ids, texts)]
            yield _batch(part.column(0), [result(w, runs_of(numbered(w), 1, None, min_words, min_exp)) for w in own])

    done = base.where("ranges = 1").select("doc_id", "text").mapInArrow(short, SCHEMA)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, doc_ids, texts, ranges, at) in rows_of(batches, "d", "doc_id", "text", "ranges", "part"):
            found = []
            for doc_id, text, r, k in zip(doc_ids, texts, ranges, at):
                x = numbered(words(doc_id, text))
                top = len(x) // min_exp
                found.append(runs_of(x, top * k // r + 1, top * (k + 1) // r + 1, min_words, min_exp))
            idx = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([part.column(0).take(idx), *(pa.array(flat[:, k]) for k in range(3))], names=["d", "start", "length", "period"])

    long = base.where("ranges > 1").select(F.xxhash64("doc_id", "text").alias("d"), "doc_id", "text", "ranges")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = long.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1))).repartition(tasks, "d", "part")
    found = dealt.mapInArrow(scan, "d long, start long, length long, period long")
    found = found.groupBy("d", "start", "length").agg(F.min("period").alias("period"))
    by_doc = found.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (doc_ids, texts, runs) in rows_of(batches, "doc_id", "text", "runs"):
            yield _batch(part.column(0), [result(words(i, t), [(r["start"], r["length"], r["period"]) for r in own or ()]) for i, t, own in zip(doc_ids, texts, runs)])

    return done.union(long.join(by_doc, "d", "left").select("doc_id", "text", "runs").mapInArrow(finish, SCHEMA))
