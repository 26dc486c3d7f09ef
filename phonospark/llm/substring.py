"""Exact substring deduplication on words, by matching statistics over an FM-index for each shard.

A word goes if it lies in a window of `length` words whose sequence also starts anywhere else. Every window
holds an *anchor*, its gram of 12 words with the least hash, so equal windows have equal anchors at the same
place. A context is the words of a run of windows with one anchor, so each window lies in one context.
Anchors that occur once are done with; the other contexts go to the shard of their anchor, equal ones (of one
anchor, by a 64-bit cryptographic digest) once with their number. Hashes only bring contexts together.

In a shard, contexts are one text in a compressed FM-index, and the documents' contexts stream through it:
backward search from every word gives its matching statistic, up to `length`, and windows whose sequence
occurs twice are reported. Contexts that are there several times need no search.

An anchor with more than `most` different contexts isn't indexed in one task: its windows are counted by a
128-bit digest of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonospark.llm.common import HOT_KEYS, cut, join_hot, rows_of, semi_join_hot, text_bytes
from phonospark.llm.fmindex import FMIndex

LENGTH, GRAM = 35, 12
#: Contexts in a shard on average, and the most differing contexts of one anchor that one task indexes.
SHARD, MOST = 8_000, 20_000
#: Windows that are looked at in one go.
PIECE = 1 << 21
_LOW = np.uint64((1 << 30) - 1)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C[1]
    return h ^ (h >> np.uint64(29))


_BYTE, _PLACE = mixed(np.arange(1, 257, dtype=np.uint64) * _C[2]), mixed(np.arange(1, 257, dtype=np.uint64) * _C[0]) | np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    place = np.arange(len(data)) - np.repeat(start, size)
    turn = _PLACE[place & 255]
    if size.max() > 256:
        turn += place.astype(np.uint64) >> np.uint64(8) << np.uint64(1)
    return mixed(np.add.reduceat(turn * _BYTE[data], start))


def gram_hashes(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every 12 words, from those of single words."""
    join = lambda a, b: mixed(a * _C[0] + b)
    two = join(h[:-1], h[1:])
    four = join(two[:-2], two[2:])
    eight = join(four[:-4], four[4:])
    return join(eight[:-4], four[8:])


def digest(words: list[bytes]) -> bytes:
    """128 bits that stand for words."""
    return blake2b(b" ".join(words), digest_size=16).digest()


def contexts(words: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first word, end) of each context, in order; `length` is over 12.

    Of equal grams the last counts, so an anchor's windows are one run. Very long texts are read in pieces
    of windows; an anchor at their border gives two contexts, with a part of its windows each.
    """
    parts = [(s, _contexts(words[s : s + PIECE + length - 1], length)) for s in range(0, max(1, len(words) - length + 1), PIECE)]
    return tuple(np.concatenate([x[k] + (np.uint64(0) if k == 0 else s) for s, x in parts]) for k in range(3))


def _contexts(words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(words) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = length - GRAM + 1
    h = gram_hashes(word_hashes(words))
    key = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    padded = np.full(-(-len(key) // w) * w, ~np.uint64(0))
    padded[: len(key)] = key
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    windows = len(key) - w + 1
    at = (_LOW - (np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows]) & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return h[at[first]], first, np.append(first[1:], windows) - 1 + length


CONTEXT = ["h", "c"]
PLACE = ["d", "doc_id", "lo", "hi"]
SPAN = "d long, doc_id long, lo int, hi int"


def anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    """(h, n): anchors of more than one context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (texts,) in rows_of(batches, "text"):
            h = [contexts(t.split(), length)[0] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *h]).view(np.int64))], names=["h"])

    return docs.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")


def context_rows(docs: DataFrame, length: int) -> DataFrame:
    """(h, c, d, doc_id, lo, hi): an anchor, its context's digest, its document, the context's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, _, texts) in rows_of(batches, "d", "doc_id", "text"):
            if not texts:
                continue
            cols: list[list] = [[] for _ in range(3)]
            digests = []
            for text in texts:
                words = text.split()
                own = contexts(words, length)
                line, begin = b" ".join(words), np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
                digests += [blake2b(line[x:y], digest_size=8).digest() for x, y in zip(begin[own[1]].tolist(), (begin[own[2]] - 1).tolist())]
                for to, x in zip(cols, own):
                    to.append(x)
            idx = pa.array(np.repeat(np.arange(len(texts)), [len(x) for x in cols[0]]))
            h, lo, hi = (np.concatenate(x) for x in cols)
            c = np.frombuffer(b"".join(digests), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), part.column(0).take(idx), part.column(1).take(idx), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=CONTEXT + PLACE)

    return docs.select("d", "doc_id", "text").mapInArrow(run, f"h long, c long, {SPAN}")


def repeated_in(found: list[bytes], asked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) start of the windows of each asked context that occur twice in all of them; -1: none."""
    own = [c.split(b" ") for c in found]
    size = np.array([len(x) for x in own])
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    number: dict[bytes, int] = {}
    text = np.zeros(int(size.sum()) + len(size), np.int64)
    inside = np.ones(len(text), bool)
    inside[begin + size] = False  # a 0 ends each context
    text[inside] = [number.setdefault(x, len(number) + 1) for words in own for x in words]
    index = FMIndex(text, length)
    windows = size[asked] - length + 1
    of = np.repeat(np.arange(len(windows)), windows)
    start = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    reach = index.matching_statistics(text, begin[asked][of] + start + length - 1)
    hit = reach >= length
    first, last = np.full(len(windows), 1 << 30), np.full(len(windows), -1)
    np.minimum.at(first, of[hit], start[hit])
    np.maximum.at(last, of[hit], start[hit])
    return np.where(last >= 0, first, -1), last


def counted_windows(brought: DataFrame, length: int) -> DataFrame:
    """Spans of what the index would report, for contexts of anchors that have too many for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (found,) in rows_of(batches, "words"):
            own = [c.split(b" ") for c in found]
            counts = [len(x) - length + 1 for x in own]
            k = np.frombuffer(b"".join(digest(x[i : i + length]) for x, n in zip(own, counts) for i in range(n)), "<i8").reshape(-1, 2)
            idx = pa.array(np.repeat(np.arange(len(counts)), counts))
            start = np.concatenate([np.arange(n, dtype=np.int32) for n in counts] or [np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(idx) for i in range(4)), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(start)], names=["n", "d", "doc_id", "lo", "k1", "k2", "start"])

    rows = brought.select("n", "d", "doc_id", "lo", "words").mapInArrow(run, "n long, d long, doc_id long, lo int, k1 long, k2 long, start int")
    times = rows.groupBy("k1", "k2").agg(F.sum("n").alias("times"), F.count("*").alias("contexts")).where("times > 1")
    hit = join_hot(rows.where("n = 1"), cut(times), ["k1", "k2"], "contexts")
    return hit.groupBy("d", "doc_id", "lo").agg(F.min("start").alias("first"), F.max("start").alias("last")).select("d", "doc_id", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("last") + length).alias("hi"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """(d, doc_id, lo, hi): spans of repeated words; they may overlap. docs has d, doc_id, text as bytes."""
    often = cut(anchor_counts(docs, length))
    found = cut(semi_join_hot(context_rows(docs, length), often, "h", "n", ["d", "lo"]))
    kinds = cut(found.groupBy(*CONTEXT).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("at")))
    copied = join_hot(found, kinds.where("n > 1").select(*CONTEXT, "n"), CONTEXT, "n").select(*PLACE)
    # anchors with a context that is there once, beside others
    open_ = cut(kinds.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").drop("least"))
    todo = cut(join_hot(kinds, open_, ["h"], "m"))
    shards = max(1, -(-todo.count() // shard))
    by_doc = todo.select(F.col("at.d").alias("_d"), F.col("at.doc_id").alias("_doc"), F.struct("h", "m", "n", "at.lo", "at.hi").alias("w")).groupBy("_d", "_doc").agg(F.collect_list("w").alias("w"))
    # a row that is there twice is brought twice: all its contexts have n > 1 then, and one more does no harm
    texts = docs.join(by_doc, (F.col("d") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("d", "doc_id", "text", "w")

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, _, texts, wants) in rows_of(batches, "d", "doc_id", "text", "w"):
            out: list[list] = [[] for _ in range(6)]
            for text, own in zip(texts, wants):
                words = text.split()
                for w in own:
                    for to, x in zip(out, (w["h"], w["m"], w["n"], w["lo"], w["hi"], b" ".join(words[w["lo"] : w["hi"]]))):
                        to.append(x)
            idx = pa.array(np.repeat(np.arange(len(texts)), [len(own) for own in wants]))
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([part.column(0).take(idx), part.column(1).take(idx), *(pa.array(x, kind) for x, kind in zip(out, kinds))], names=["d", "doc_id", "h", "m", "n", "lo", "hi", "words"])

    def search(table: pa.Table) -> pa.Table:
        asked = np.flatnonzero(table.column("n").to_numpy() == 1)
        if not len(asked):
            return table.select(PLACE).slice(0, 0)
        first, last = repeated_in(table.column("words").to_pylist(), asked, length)
        hit = last >= 0
        own = table.select(PLACE).take(pa.array(asked[hit]))
        lo = own.column("lo").to_numpy()
        return pa.table([own.column("d"), own.column("doc_id"), pa.array((lo + first[hit]).astype(np.int32)), pa.array((lo + last[hit] + length).astype(np.int32))], names=PLACE)

    brought = texts.mapInArrow(bring, "d long, doc_id long, h long, m long, n long, lo int, hi int, words binary")
    hot = open_.where(F.col("m") > most).count()
    if hot:
        brought = cut(brought)
    indexed = brought.where(F.col("m") <= most).withColumn("shard", F.pmod("h", F.lit(shards))).groupBy("shard").applyInArrow(search, SPAN)
    spans = copied.union(indexed)
    return spans.union(counted_windows(brought.where(F.col("m") > most), length)) if hot else spans


def remove_repeated(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """docs' doc_id with kept (the words left, joined by one space), n_words, n_removed, n_spans.

    Words are what lies between ASCII white space. Null and empty texts have no words. Texts of fewer than
    `length` words lose nothing. Copies of a row count as other documents, so they remove each other; a null
    doc_id is a document like any other. No rows give no rows. Texts are read whole, in pieces where they are
    very long. Columns of docs other than doc_id and text aren't read, whatever their names.
    """
    base = docs.select("doc_id", text_bytes().alias("text"))
    base = base.select(F.xxhash64("doc_id", "text").alias("d"), "doc_id", "text")
    spans = repeated_spans(base, length, shard, most).groupBy(F.col("d").alias("_d"), F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    joined = base.join(spans, (F.col("d") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (texts, spans) in rows_of(batches, "text", "spans"):
            kept, sizes, removed, counts = [], [], [], []
            for text, own in zip(texts, spans):
                words, left, end, runs = text.split(), [], 0, 0
                for s in own or ():
                    if s["lo"] > end or not runs:
                        left += words[end : s["lo"]]
                        runs += 1
                    end = max(end, s["hi"])
                left += words[end:]
                kept.append(b" ".join(left).decode("utf-8", "replace"))
                sizes.append(len(words))
                removed.append(len(words) - len(left))
                counts.append(runs)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts))], names=["doc_id", "kept", "n_words", "n_removed", "n_spans"])

    return joined.mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long, n_spans long")
