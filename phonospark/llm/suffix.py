"""Exact substring deduplication with suffix arrays made by induced sorting.

A byte goes if it lies in a string of `length` bytes that starts anywhere else as well. Every such
string holds an *anchor*: the least hash of the 32-byte grams within it, so both copies have the same
anchor at the same place. Anchors are found where documents lie; those that occur once are done with.
An anchor's context is all strings of `length` bytes whose least gram it is. Equal contexts of an anchor,
by a 128-bit cryptographic digest of their bytes, are one context with a multiplicity. Hashes only bring
contexts together: the bytes of every context go to the shard of its anchor, whose suffix array decides.

In a shard, each anchor's contexts are one text, without the bytes further from the anchor than any other
context agrees (bounds in steps of 42 bytes), which no repeated window reaches. Suffixes are sorted by induced sorting: they are
classified as S or L, the leftmost S substrings are sorted by inducing from their first characters,
named, and the text of their names is sorted by the same procedure; all others are induced from them in
two passes, each linear. Many short texts are induced side by side, one step of each at a time. The
permuted common prefixes are computed where they are irreducible and carried on elsewhere; runs of at
least `length` tell which windows are equal.

An anchor with more than `most` different contexts isn't sorted in one task: its windows are counted by
their distance to the anchor and a 128-bit digest of their bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonospark.llm.common import HOT_KEYS, cut, join_hot, rows_of, semi_join_hot, text_bytes

LENGTH, GRAM = 200, 32
#: Contexts in a shard on average.
SHARD = 8_000
#: The most differing contexts of one anchor that are sorted in one task.
MOST = 8_000
#: Bytes beside an anchor by which contexts are compared before they are sorted.
STEP = 42
#: Windows that are looked at in one go.
PIECE = 1 << 24
_LOW = np.uint64((1 << 30) - 1)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def gram_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every 32-byte gram."""
    n = len(text)
    h = np.ndarray((n - 7,), "<u8", text, 0, (1,)) * _C[0]
    h ^= h >> np.uint64(29)
    for step, c in ((8, _C[1]), (16, _C[2])):
        h = h[:-step] * c + h[step:]
        h ^= h >> np.uint64(31)
        h *= _C[0]
        h ^= h >> np.uint64(32)
    return h


def digest(context: bytes, place: int) -> bytes:
    """128 bits that stand for a context's bytes and the anchor's place in it."""
    return blake2b(context + place.to_bytes(4, "little"), digest_size=16).digest()


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(position, hash, start of the first and of the last window whose least gram it is) of each anchor.

    Of equal grams the last counts, so an anchor's windows are one run. Very long texts are read in
    pieces of windows; an anchor at their border gives two rows, with a part of its windows each.
    """
    parts = [(s, _anchors(text[s : s + PIECE + length - 1], length)) for s in range(0, max(1, len(text) - length + 1), PIECE)]
    return tuple(np.concatenate([x[k] + (s if k != 1 else np.uint64(0)) for s, x in parts]) for k in range(4))


def _anchors(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    w = length - GRAM + 1
    if len(text) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(text)
    key = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    rows = -(-len(key) // w)
    grid = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(key)] = key
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    windows = len(key) - w + 1
    at = (_LOW - (np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows]) & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], windows) - 1
    return at[first], h[at[first]], first, last


def anchor_hashes(docs: DataFrame, length: int) -> DataFrame:
    """(h): each anchor, alone; most occur once, and these need no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (texts,) in rows_of(batches, "text"):
            if texts:
                h = np.concatenate([anchors(text, length)[1] for text in texts])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return docs.select("text").mapInArrow(run, "h long")


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(h, c1, c2, d, doc_id, lo, hi, a): an anchor, its context's digest, its document, the context, its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (ds, doc_ids, texts) in rows_of(batches, "d", "doc_id", "text"):
            cols: list[list] = [[] for _ in range(4)]
            counts, digests = [], []
            for text in texts:
                at, h, lo, last = anchors(text, length)
                hi = last + length
                digests += [digest(text[x:y], a) for x, y, a in zip(lo.tolist(), hi.tolist(), (at - lo).tolist())]
                counts.append(len(at))
                for to, x in zip(cols, (h, lo, hi, at)):
                    to.append(x)
            if not texts:
                continue
            h, lo, hi, at = (np.concatenate(x) for x in cols)
            c = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            idx = pa.array(np.repeat(np.arange(len(texts)), counts))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), part.column(0).take(idx), part.column(1).take(idx), *(pa.array(x.astype(np.int32)) for x in (lo, hi, at))], names=["h", "c1", "c2", "d", "doc_id", "lo", "hi", "a"])

    return docs.select("d", "doc_id", "text").mapInArrow(run, "h long, c1 long, c2 long, d long, doc_id long, lo int, hi int, a int")


def first_rows(keys: np.ndarray) -> np.ndarray:
    """For sorted keys, the index of each key's first row."""
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


class Texts:
    """Columns of a matrix as texts: column b holds one in its first n[b] rows, ending with its only 0.

    Places and slots are row * width + column, so that one step handles a row of all columns at once.
    """

    def __init__(self, t: np.ndarray, n: np.ndarray) -> None:
        self.t, self.n, (self.rows, self.width) = t, n, t.shape
        self.k = int(t.max()) + 1
        self.col = np.arange(self.width)
        row = np.arange(self.rows)[:, None]
        self.live = row < n
        up = np.zeros(t.shape, np.int8)
        up[:-1] = np.sign(t[1:] - t[:-1])
        up[n - 1, self.col] = 1
        at = np.minimum.accumulate(np.where(up != 0, row, self.rows - 1)[::-1])[::-1]
        self.s = np.take_along_axis(up, at, 0) > 0  # smaller than the next suffix
        lms = self.s & self.live
        lms[1:] &= ~self.s[:-1]
        lms[0] = False
        lms[n - 1, self.col] = True
        self.lms = lms
        counts = np.bincount((t * self.width + self.col)[self.live], minlength=self.k * self.width).reshape(self.k, self.width)
        self.ends = np.cumsum(counts, 0)
        self.heads = self.ends - counts

    def before(self, kind: np.ndarray) -> np.ndarray:
        """For each place, the bucket of the character before it, where that one is of this kind."""
        out = np.full((self.rows + 1, self.width), self.k, np.int64)
        out[1 : self.rows] = np.where((kind & self.live)[:-1], self.t[:-1], self.k)
        return (out * self.width + self.col).ravel()

    def induced(self, cols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """All suffixes in order, from leftmost S suffixes (by column, then by rank); a matrix of rows."""
        w, rows, k = self.width, self.rows, self.k
        c = self.t[places, cols]
        group = cols * k + c
        sizes = np.bincount(group, minlength=w * k)[group]
        slot = self.ends[c, cols] - sizes + np.arange(len(c)) - first_rows(group)
        # rows from `rows` on take what isn't wanted
        sa = np.full(((2 * rows + 1), w), rows, np.int64)
        sa[slot, cols] = places
        sa = (sa * w + self.col).ravel()
        head = np.vstack([self.heads, np.full((1, w), rows)]) * w + self.col
        tail = np.vstack([self.ends, np.full((1, w), 2 * rows + 1)]) * w + self.col
        head, tail = head.ravel(), tail.ravel()
        large, small = self.before(~self.s), self.before(self.s)
        for r in range(0, rows * w, w):
            at = sa[r : r + w]
            bucket = large[at]
            to = head[bucket]
            sa[to] = at - w
            head[bucket] = to + w
        for r in range((rows - 1) * w, -1, -w):
            at = sa[r : r + w]
            bucket = small[at]
            to = tail[bucket] - w
            sa[to] = at - w
            tail[bucket] = to
        return sa[: rows * w].reshape(rows, w) // w

    def sorted(self) -> np.ndarray:
        cols, places = np.nonzero(self.lms.T)
        order = np.argsort(cols * self.k + self.t[places, cols], kind="stable")
        first = self.induced(cols[order], places[order]).T
        m = np.bincount(cols, minlength=self.width)
        inside = np.arange(self.rows)[None, :] < self.n[:, None]
        mask = inside & self.lms[np.where(inside, first, 0), self.col[:, None]]
        ranked = first[mask]  # by column, as the substrings are ordered
        names, unique = self.named(cols, places, ranked)
        todo = np.flatnonzero(~unique)
        if len(todo):
            number = np.full((self.rows, self.width), 0)
            number[ranked, cols] = names
            offset = np.arange(len(cols)) - first_rows(cols)
            use = ~unique[cols]
            to = np.cumsum(~unique) - 1
            less = np.zeros((int(m[todo].max()), len(todo)), np.int64)
            less[offset[use], to[cols[use]]] = number[places[use], cols[use]]
            deep = Texts(less, m[todo]).sorted().T
            start = np.concatenate(([0], np.cumsum(m)[:-1]))
            own = deep[np.arange(deep.shape[1])[None, :] < m[todo][:, None]]
            ranked[use] = places[np.repeat(start[todo], m[todo]) + own]
        return self.induced(cols, ranked)

    def named(self, cols: np.ndarray, places: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the ranked substrings within their columns, and whether a column's are all different."""
        end = np.zeros((self.rows, self.width), np.int64)
        last = np.append(cols[1:] != cols[:-1], True)
        end[places, cols] = np.where(last, places, np.append(places[1:], 0))
        size = end[ranked, cols] - ranked
        same = np.concatenate(([False], (cols[1:] == cols[:-1]) & (size[1:] == size[:-1])))
        at, k, t, flat = np.flatnonzero(same), 0, self.t.ravel(), ranked * self.width + cols
        while len(at):
            same[at] = t[flat[at] + k * self.width] == t[flat[at - 1] + k * self.width]
            at = at[same[at] & (k < size[at])]
            k += 1
        count = np.cumsum(~same)
        tied = np.zeros(self.width, bool)
        tied[cols[same]] = True
        return count - count[first_rows(cols)], ~tied


def sort_one(t: list[int], k: int) -> list[int]:
    """The same for one text: a list that ends with its only 0, of characters below k."""
    n = len(t)
    if n == 1:
        return [0]
    small = bytearray(n)
    small[-1] = 1
    for i in range(n - 2, -1, -1):
        small[i] = t[i] < t[i + 1] or t[i] == t[i + 1] and small[i + 1]
    seeds = [i for i in range(1, n) if small[i] and not small[i - 1]]
    sizes = [0] * k
    for c in t:
        sizes[c] += 1
    ends = list(accumulate(sizes))

    # the bucket of the character before each place, if it is L, or S; -1 elsewhere and for n, which is no place
    large = [-1, *(-1 if x else c for x, c in zip(small, t))]
    tail = [-1, *(c if x else -1 for x, c in zip(small, t))]
    large[n] = tail[n] = -1

    def induced(ordered: list[int]) -> list[int]:
        sa, at = [n] * n, ends[:]
        for i in reversed(ordered):
            k = at[t[i]] = at[t[i]] - 1
            sa[k] = i
        at = [0, *ends[:-1]]
        for i in sa:  # sees what is put ahead of it
            c = large[i]
            if c >= 0:
                sa[at[c]] = i - 1
                at[c] += 1
        at = ends[:]
        for i in reversed(sa):
            c = tail[i]
            if c >= 0:
                k = at[c] = at[c] - 1
                sa[k] = i - 1
        return sa

    ends_at = dict(zip(seeds, seeds[1:] + seeds[-1:]))
    ranked = [i for i in induced(seeds) if i in ends_at]
    names, last, name = {}, None, -1
    for i in ranked:
        own = t[i : ends_at[i] + 1]
        name += own != last
        names[i], last = name, own
    if name + 1 < len(seeds):
        ranked = [seeds[i] for i in sort_one([names[i] for i in seeds], name + 1)]
    return induced(ranked)


#: Cells of a matrix of texts. Costs of sorting, in microseconds: a row of a matrix, and more for each of its
#: texts; a character of a text on its own. They only choose the way, not the result.
CELLS, ROW_COST, TEXT_COST, ONE_COST = 400_000, 40.0, 0.6, 2.5


def suffix_arrays(t: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffixes of each text in order, one text after the other; texts lie one after the other in t."""
    sa = np.zeros(len(t), np.int64)
    order = np.argsort(size, kind="stable")
    sums, end = np.concatenate(([0], np.cumsum(size[order]))), len(order)
    while end:
        top = int(size[order[end - 1]])
        most = max(1, min(end, CELLS // top))
        # of all runs of texts that end here, the one that saves most over sorting its texts one by one
        count = np.arange(1, most + 1)
        saved = ONE_COST * (sums[end] - sums[end - count]) - top * (ROW_COST + TEXT_COST * count)
        best = int(saved.argmax())
        own = order[end - 1 - best : end] if saved[best] > 0 else order[end - 1 : end]
        end -= len(own)
        if saved[best] <= 0:
            b, n = int(begin[own[0]]), top
            text = t[b : b + n]
            sa[b : b + n] = np.array(sort_one(text.tolist(), int(text.max()) + 1)) + b
            continue
        n = size[own]
        rows = np.arange(int(n.max()))[:, None]
        live = rows < n
        place = np.where(live, begin[own] + rows, 0)
        got = Texts(np.where(live, t[place].astype(np.int64), 0), n).sorted()
        sa[place.T[live.T]] = (got + begin[own]).T[live.T]
    return sa


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, stops: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, within its own context.

    stops: for each position, where its context ends; starts: where contexts begin.
    """
    n = len(t)
    before = np.zeros(n, np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = n - 1
    left = np.concatenate((t[-1:], t[:-1]))
    own = left != left[before]
    own[starts] = True
    at = np.flatnonzero(own)
    at = at[stops[at] > at]
    got = np.zeros(n, np.int32)
    wide = np.ndarray((n,), "<u8", np.concatenate((t, np.zeros(4, t.dtype))).tobytes(), 0, (2,))
    here, k = at, 0
    while len(here):
        other = np.minimum(before[here] + k, n - 1)
        x = wide[np.minimum(here + k, n - 1)] ^ wide[other]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 4, np.bitwise_count(low - np.uint64(1)) // 16).astype(np.int32)
        got[here] += same
        here = here[(same == 4) & (here + k + 4 < stops[here])]
        k += 4
    reach = np.zeros(n, np.int32)
    reach[at] = at + got[at]
    reach = np.minimum(np.maximum.accumulate(reach), stops)
    return np.maximum(0, reach - np.arange(n, dtype=np.int32))


def agreement(group: list[int], sides: list[bytes], room: int) -> np.ndarray:
    """A bound, in steps of STEP, on the bytes at the head of each side that are in another side of its group too."""
    bound, live = np.full(len(sides), STEP - 1), range(len(sides))
    for k in range(STEP, room + 1, STEP):
        live = [i for i in live if len(sides[i]) >= k]
        keys = [(group[i], sides[i][:k]) for i in live]
        times = Counter(keys)
        live = [i for i, key in zip(live, keys) if times[key] > 1]
        bound[live] = k + STEP - 1
    return bound


def repeated_in(group: np.ndarray, weight: np.ndarray, place: np.ndarray, contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) start of the windows of each context that occur twice in its group; -1: none.

    place: the anchor's offset in its context. Windows count at equal distance to the anchor only. Rows of
    a group follow each other. A window that another context has as well reaches no further from the anchor,
    to either side, than the contexts agree there, so only that part of a context is sorted; contexts that
    are there several times are sorted whole.
    """
    of, room, several = group.tolist(), length - GRAM, weight > 1
    before = agreement(of, [c[:p][::-1] for p, c in zip(place.tolist(), contexts)], room)
    after = agreement(of, [c[p + GRAM :] for p, c in zip(place.tolist(), contexts)], room)
    sizes = np.array([len(c) for c in contexts])
    start = np.where(several, 0, np.maximum(0, place - before))
    end = np.where(several, sizes, np.minimum(sizes, place + GRAM + after))
    first, last = np.full(len(sizes), -1), np.full(len(sizes), -1)
    use = np.flatnonzero(end - start >= length)
    if len(use):
        parts = [contexts[i][x:y] for i, x, y in zip(use.tolist(), start[use].tolist(), end[use].tolist())]
        low, high = repeated_windows(group[use], weight[use], (place - start)[use], parts, length)
        first[use], last[use] = (np.where(x >= 0, x + start[use], -1) for x in (low, high))
    return first, last


def repeated_windows(group: np.ndarray, weight: np.ndarray, place: np.ndarray, contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by the suffix arrays of the groups' contexts."""
    sizes = np.array([len(c) for c in contexts])
    new = np.concatenate(([True], group[1:] != group[:-1]))
    heads = np.flatnonzero(new)
    text_of = np.cumsum(new) - 1
    # contexts end with a 1, texts with a 0 after it
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) + text_of
    total = int(sizes.sum() + len(sizes) + len(heads))
    t = np.zeros(total, np.uint16)
    stops = np.repeat(begin + sizes, sizes)
    inside = np.arange(len(stops)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
    t[inside] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + np.uint16(2)
    t[begin + sizes] = 1
    stop_at, of = np.zeros(total, np.int32), np.zeros(total, np.int32)
    stop_at[inside], of[inside] = stops, np.repeat(np.arange(len(sizes)), sizes)
    starts = begin[heads]
    sa = suffix_arrays(t, starts, np.diff(np.append(starts, total)))
    prefix = permuted_prefixes(t, sa, stop_at, begin)
    run = np.cumsum(prefix[sa] < length, dtype=np.int64)
    use = stop_at[sa] - sa >= length
    sa, run = sa[use], run[use]
    c = of[sa]
    offset = sa - begin[c]
    key = run * (2 * length) + (offset - place[c] + length)
    order = np.argsort(key, kind="stable")
    first, last = np.full(len(sizes), -1), np.full(len(sizes), -1)
    if len(order):
        cuts = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        times = np.add.reduceat(weight[c[order]], cuts)
        hit = order[np.repeat(times >= 2, np.diff(np.append(cuts, len(order))))]
        low, high = np.full(len(sizes), 1 << 30), np.full(len(sizes), -1)
        np.minimum.at(low, c[hit], offset[hit])
        np.maximum.at(high, c[hit], offset[hit])
        first, last = np.where(high >= 0, low, -1), high
    return first, last


CONTEXT = ["h", "c1", "c2"]
VERDICT = "h long, c1 long, c2 long, n long, first long, last long"


def window_verdicts(brought: DataFrame, length: int) -> DataFrame:
    """What sorting gives, for contexts of anchors that have too many for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (places, contexts) in rows_of(batches, "p", "c"):
            keys = [digest(c[i : i + length], p - i) for p, c in zip(places, contexts) for i in range(len(c) - length + 1)]
            counts = [len(c) - length + 1 for c in contexts]
            k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            idx = pa.array(np.repeat(np.arange(len(counts)), counts))
            start = np.concatenate([np.arange(n) for n in counts] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(idx) for i in range(4)), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(start)], names=[*CONTEXT, "n", "k1", "k2", "start"])

    rows = brought.select(*CONTEXT, "n", "p", "c").mapInArrow(run, "h long, c1 long, c2 long, n long, k1 long, k2 long, start long")
    times = rows.groupBy("h", "k1", "k2").agg(F.sum("n").alias("times"), F.count("*").alias("contexts")).where("times > 1")
    hit = join_hot(rows, cut(times), ["h", "k1", "k2"], "contexts")
    return hit.groupBy(*CONTEXT, "n").agg(F.min("start").alias("first"), F.max("start").alias("last"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """(d, doc_id, lo, hi): spans of repeated bytes; they may overlap. docs has d, doc_id, text as bytes."""
    rows = anchor_rows(docs, length)
    often = cut(anchor_hashes(docs, length).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    found = cut(semi_join_hot(rows, often, "h", "n", ["d", "lo"]))
    kinds = cut(found.groupBy(*CONTEXT).agg(F.count("*").alias("n"), F.min(F.struct("d", "doc_id", "lo", "hi", "a")).alias("at")))
    hot = cut(kinds.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > most))
    shards = max(1, -(-kinds.count() // shard))
    by_doc = kinds.select(*CONTEXT, "n", "at.*").groupBy(F.col("d").alias("_d"), F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct(*CONTEXT, "n", "lo", "hi", "a")).alias("w"))
    # a row that is there twice is brought twice: all its contexts have n > 1 then, and one more does no harm
    texts = docs.join(by_doc, (F.col("d") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("text", "w")

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.binary()]
        for _, (texts, wants) in rows_of(batches, "text", "w"):
            out = [(w["h"], w["c1"], w["c2"], w["n"], w["a"] - w["lo"], t[w["lo"] : w["hi"]]) for t, ws in zip(texts, wants) for w in ws]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=[*CONTEXT, "n", "p", "c"])

    def sort(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending")])
        h, n, p = (table.column(x).to_numpy() for x in ("h", "n", "p"))
        first, last = repeated_in(h, n, p, table.column("c").to_pylist(), length)
        out = table.select([*CONTEXT, "n"]).append_column("first", pa.array(first)).append_column("last", pa.array(last))
        return out.filter(pa.array(first >= 0))

    def sorted_verdicts(own: DataFrame) -> DataFrame:
        return own.withColumn("shard", F.pmod("h", F.lit(shards))).groupBy("shard").applyInArrow(sort, VERDICT)

    brought = texts.mapInArrow(bring, "h long, c1 long, c2 long, n long, p long, c binary")
    few = hot.count()
    if not few:
        verdicts = sorted_verdicts(brought)
    else:
        brought = cut(brought)
        mark = F.broadcast(hot.select("h")) if few <= HOT_KEYS else hot.select("h")
        verdicts = sorted_verdicts(brought.join(mark, "h", "left_anti")).union(window_verdicts(brought.join(mark, "h", "left_semi"), length).select("h", "c1", "c2", "n", "first", "last"))
    verdicts = cut(verdicts.groupBy(*CONTEXT).agg(F.max("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")))
    return join_hot(found, verdicts, CONTEXT, "n").select("d", "doc_id", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("last") + length).alias("hi"))


def remove_repeated(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """docs' doc_id with kept (the bytes left, in order), n_bytes, n_removed, n_spans.

    Null and empty texts are zero bytes. Texts shorter than `length` lose nothing. Copies of a row count
    as other documents, so they remove each other; a null doc_id is a document like any other. No rows give
    no rows. Texts are read whole, in pieces where they are very long, up to the 2^31 - 1 bytes that a value
    can have. Columns of docs other than doc_id and text aren't read, whatever their names.
    """
    base = docs.select("doc_id", text_bytes().alias("text"))
    base = base.select(F.xxhash64("doc_id", "text").alias("d"), "doc_id", "text")
    spans = repeated_spans(base, length, shard, most).groupBy(F.col("d").alias("_d"), F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    joined = base.join(spans, (F.col("d") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (texts, spans) in rows_of(batches, "text", "spans"):
            kept, sizes, removed, counts = [], [], [], []
            for text, own in zip(texts, spans):
                left, end, runs = [], 0, 0
                for s in own or ():
                    lo, hi = s["lo"], min(s["hi"], len(text))
                    if lo > end or not runs:
                        left.append(text[end:lo])
                        runs += 1
                    end = max(end, hi)
                left.append(text[end:])
                kept.append(b"".join(left))
                sizes.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                counts.append(runs)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
