"""Benchmark decontamination by greedy string tiling.

Words of documents are numbered by the benchmark's vocabulary, runs of known words are hashed by
Karp-Rabin over min_match words, and hashes that are seeds of a benchmark item join document and item.
Each joined pair is tiled: the longest common run of unmarked words is marked on both sides, again
and again, until no run of min_match words is left. Tiles may lie in any order, so reordered passages
count as well. A pair is contaminated where tiles cover enough of the item's words.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonospark.llm.common import cut, join_hot, row_key, rows_of

MIN_MATCH, MIN_COVERAGE = 5, 0.8
#: The most bytes of benchmark text that are broadcast; seeds of a larger benchmark meet the documents' in a join.
BROADCAST_BYTES = 16 << 20
BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n ids; the modulus is 2^64."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    u, h = ids.astype(np.uint64) + np.uint64(1), np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = h * BASE + u[k : len(u) - n + 1 + k]
    return h


class Runs:
    """Karp-Rabin hashes of runs of any length over ids, runs with a negative id left out.

    Hashes of runs of 1, 2, 4, ... ids are kept; one of another length is put together from two of them.
    """

    def __init__(self, x: np.ndarray) -> None:
        u = x.astype(np.uint64) + np.uint64(1)
        u ^= u >> np.uint64(31)
        self.levels, self.gaps = [u * _MIX], np.concatenate(([0], np.cumsum(x < 0)))

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            h, n = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(h[:-n] * BASE + (h[n:] ^ (h[n:] >> np.uint64(29))) if len(h) > n else h[:0])
        return self.levels[k]

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of all runs of n ids."""
        k = n.bit_length() - 1
        h, count = self.level(k), len(self.gaps) - n
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = (h[:count] ^ (h[:count] >> np.uint64(32))) * _MIX + h[n - (1 << k) :][:count]
        at = np.flatnonzero(self.gaps[n:] == self.gaps[:-n])
        return at, whole[at]


def tile(doc: np.ndarray, item: np.ndarray, at: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(doc start, item start, length) of greedy tiles; at: where seeds of the item begin in doc, in order.

    Each round finds the length of the longest common run of unmarked words, by halving, and marks all
    runs of that length, from the left of doc and then of item. Lengths fall from round to round, so there
    are at most as many rounds as different lengths, each a few passes over hashes.
    """
    d, t, tiles = np.full(len(doc), -1), item.copy(), []
    for j in range(min_match):
        d[at + j] = doc[at + j]
    high = min(len(d), len(t))
    while True:
        mine, other = Runs(d), Runs(t)
        shared = lambda n: np.isin(mine.of(n)[1], other.of(n)[1]).any()
        if high < min_match or not shared(min_match):
            return tiles
        low = min_match
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if shared(n) else (low, n - 1)
        places: dict[int, deque] = defaultdict(deque)
        for i, h in zip(*(x.tolist() for x in other.of(low))):
            places[h].append(i)
        end, found = 0, False
        for j, h in zip(*(x.tolist() for x in mine.of(low))):
            if j < end or h not in places:
                continue
            queue = places[h]
            while queue and (t[queue[0]] < 0 or t[queue[0] + low - 1] < 0):
                queue.popleft()
            if queue and np.array_equal(d[j : j + low], t[queue[0] : queue[0] + low]):
                i, end, found = queue.popleft(), j + low, True
                tiles.append((j, i, low))
                d[j:end], t[i : i + low] = -1, -2
        high = low if found else low - 1


class Items:
    """Benchmark items: vocabulary, numbered words, seeds in order with their items."""

    def __init__(self, rows: list[tuple[int, str]], min_match: int) -> None:
        self.min_match, self.vocabulary = min_match, {}
        self.ids, self.words = [r[0] for r in rows], []
        number = self.vocabulary
        for _, text in rows:
            self.words.append(np.array([number.setdefault(w, len(number)) for w in words_of(text)], dtype=np.int64))
        hashes = [np.unique(rolling(w, min_match)) for w in self.words]
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        of = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        order = np.argsort(h, kind="stable")
        self.seeds, self.owner = h[order], of[order]

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int]]:
        """(item, words covered, tiles) for every item that shares a seed; a seed is known by its words' numbers."""
        get, m = self.vocabulary.get, self.min_match
        doc = np.array([get(w, -1) for w in words_of(text)], dtype=np.int64)
        known = np.concatenate(([0], np.cumsum(doc >= 0)))
        at = np.flatnonzero(known[m:] - known[:-m] == m) if len(doc) >= m else np.zeros(0, np.int64)
        if not len(at) or not len(self.seeds):
            return
        h = rolling(doc, m)[at]
        lo, hi = np.searchsorted(self.seeds, h), np.searchsorted(self.seeds, h, "right")
        hit = hi > lo
        at, lo, hi = at[hit], lo[hit], hi[hit]
        if not len(at):
            return
        where = np.repeat(at, hi - lo)
        owner = self.owner[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])]
        for k in np.unique(owner).tolist():
            tiles = tile(doc, self.words[k], np.unique(where[owner == k]), m)
            if tiles:
                yield k, sum(n for _, _, n in tiles), len(tiles)


NAMES = ["doc_id", "item_id", "n_words", "n_covered", "n_tiles", "coverage"]
FOUND = "doc_id long, item_id long, n_words long, n_covered long, n_tiles long, coverage double"


def _seeds(rows: DataFrame, min_match: int, *keys: str) -> DataFrame:
    """(h, keys): the different seeds of each row's text, as hashes of min_match words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, cache = xxhash.xxh3_64_intdigest, {}
        for part, (texts,) in rows_of(batches, "text"):
            own = []
            for text in texts:
                words = words_of(text)
                cache.update((w, hashed(w)) for w in set(words) - cache.keys())
                own.append(np.unique(rolling(np.array([cache[w] for w in words], np.uint64), min_match)).view(np.int64))
                if len(cache) > 200_000:
                    cache.clear()
            idx = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*own, np.zeros(0, np.int64)])), *(part.column(part.schema.get_field_index(k)).take(idx) for k in keys)], names=["h", *keys])

    return rows.select("text", *keys).mapInArrow(run, ", ".join(f"{k} long" for k in ("h", *keys)))


def _joined(docs: DataFrame, items: DataFrame, min_match: int, min_coverage: float) -> DataFrame:
    """(k1, k2, found, again) by a join of seeds: rows of docs (k1, k2, doc_id, text), what they hold, copies of that item."""
    items = cut(items.groupBy("item_id", "text").agg(F.count("*").alias("again")).withColumn("i", row_key(["item_id", "text"], 3)))
    own = _seeds(docs, min_match, "k1", "k2")
    known = cut(_seeds(items, min_match, "i").distinct())
    seen = own.join(known.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.count("*").alias("seen"))
    known = cut(known.join(seen, "h"))
    pairs = cut(join_hot(own, known, ["h"], "seen").select("k1", "k2", "i").distinct())
    both = pairs.join(docs.dropDuplicates(["k1", "k2"]), ["k1", "k2"]).join(items.select("i", "again", "item_id", F.col("text").alias("item")), "i").select("k1", "k2", "again", "doc_id", "item_id", "text", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (doc_ids, item_ids, texts, others) in rows_of(batches, "doc_id", "item_id", "text", "item"):
            out = []
            for doc_id, item_id, text, other in zip(doc_ids, item_ids, texts, others):
                held = Items([(item_id, other)], min_match)
                n, covered, tiles = len(held.words[0]), 0, 0
                for _, covered, tiles in held.matches(text):
                    pass
                out.append((doc_id, item_id, n, covered, tiles, covered / n) if covered >= min_coverage * n else None)
            found = pa.array([r and dict(zip(NAMES, r)) for r in out], pa.struct([(c, pa.float64() if c == "coverage" else pa.int64()) for c in NAMES]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), found], names=["k1", "k2", "again", "found"]).filter(found.is_valid())

    return both.mapInArrow(run, f"k1 long, k2 long, again long, found struct<{FOUND.replace(' ', ':').replace(',:', ',')}>")


def _held(benchmark: DataFrame, min_match: int, broadcast_bytes: int) -> tuple[DataFrame, Items | None]:
    """The items that have a text, and ready to be sent around where they are few enough."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, Items([tuple(r) for r in items.collect()], min_match) if size <= broadcast_bytes else None


def contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, n_tiles, coverage) of every pair with coverage >= min_coverage.

    Words are lower-cased runs of letters, digits and underscores. Null or empty texts match nothing, nor
    do items of fewer than min_match words, which have no seed. Repeated documents or items give repeated
    pairs; of tiles of equal length the leftmost in the document counts first. Empty tables give no rows.
    Texts are read whole, however long; other columns aren't read, whatever their names.
    """
    items, held = _held(benchmark, min_match, broadcast_bytes)
    if held is None:
        rows = docs.select("doc_id", "text").select(row_key(["doc_id", "text"], 1).alias("k1"), row_key(["doc_id", "text"], 2).alias("k2"), "doc_id", "text")
        copies = rows.groupBy("k1", "k2").agg(F.count("*").alias("times"))
        out = _joined(rows, items, min_match, min_coverage).join(copies, ["k1", "k2"])
        return out.select("found.*", F.explode(F.sequence(F.lit(1), F.col("times") * F.col("again"))).alias("_")).drop("_")
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for _, (doc_ids, texts) in rows_of(batches, "doc_id", "text"):
            out: list[list] = [[] for _ in NAMES]
            for doc_id, text in zip(doc_ids, texts):
                for k, covered, tiles in own.matches(text):
                    n = len(own.words[k])
                    if covered >= min_coverage * n:
                        for to, x in zip(out, (doc_id, own.ids[k], n, covered, tiles, covered / n)):
                            to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if c == "coverage" else pa.int64()) for c, x in zip(NAMES, out)], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs, with all their columns, without the rows whose own text is contaminated, whatever their doc_id."""
    items, held = _held(benchmark, min_match, broadcast_bytes)
    if held is None:
        whole = docs.select(F.struct("*").alias("row"), row_key(["text"], 1).alias("k1"), row_key(["text"], 2).alias("k2"))
        texts = whole.select("k1", "k2", F.lit(0).cast("long").alias("doc_id"), "row.text").where(F.col("text").isNotNull())
        bad = _joined(texts, items, min_match, min_coverage).select("k1", "k2").distinct()
        return whole.join(bad, ["k1", "k2"], "left_anti").select("row.*")
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part, (texts,) in rows_of(batches, "text"):
            clean = [all(covered < min_coverage * len(own.words[i]) for i, covered, _ in own.matches(text)) for text in texts]
            yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
