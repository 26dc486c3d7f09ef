"""A compressed index of a text of numbers: backward search over a wavelet tree.

The text is kept as its Burrows-Wheeler transform in a wavelet tree whose shape follows the code lengths
ceil(log2(n / occurrences)), so it takes at most a bit a symbol more than the entropy, and a frequent symbol
few levels. All queries of a call are searched side by side, one step of each at a time.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """A packed row of bits that counts the ones before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        packed[: -(-n // 8)] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """How often a symbol occurs before a place of a sequence. Symbols are numbered by falling frequency."""

    def __init__(self, seq: np.ndarray) -> None:
        count = np.bincount(seq)
        n, k = len(seq), len(count)
        self.size = np.maximum(1, np.ceil(np.log2(n / count)).astype(np.int64))
        top = int(self.size[-1])
        # canonical codes, aligned at their first bit
        self.code = np.concatenate(([0], np.cumsum(1 << (top - self.size))[:-1]))
        total = np.concatenate(([0], np.cumsum(count)))
        self.levels: list[tuple[Bits, int, np.ndarray, np.ndarray, np.ndarray]] = []
        starts = np.zeros(k, np.int64)
        for level in range(top):
            alive = int(np.searchsorted(self.size, level, "right"))  # shorter codes have ended
            bit = (self.code[alive:] >> (top - 1 - level) & 1).astype(bool)
            own = bit[seq - alive]
            bits = Bits(own)
            begin = bits.ones(starts)
            self.levels.append((bits, alive, starts.astype(np.int32), begin.astype(np.int32), bit))
            low = int(np.searchsorted(self.size, level + 1, "right"))
            if low == k:
                break
            prefix = self.code[low:] >> (top - 1 - level)
            first = np.searchsorted(prefix, prefix, "left")
            following = total[low + first] - total[low]
            # stable by one bit more: a place in the child's node is the count of that bit in its own
            place = np.arange(len(seq))
            ones = np.cumsum(own) - own
            live = seq >= low
            s = seq[live]
            inside = np.where(own[live], ones[live] - begin[s - alive], place[live] - starts[s - alive] - (ones[live] - begin[s - alive]))
            moved = np.empty(len(s), seq.dtype)
            moved[following[s - low] + inside] = s
            seq, starts = moved, following

    def count(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in so many first places."""
        out = before.copy()
        todo = np.arange(len(symbol))
        for bits, alive, starts, begin, bit in self.levels:
            todo = todo[symbol[todo] >= alive]
            if not len(todo):
                break
            s, at = symbol[todo] - alive, out[todo]
            ones = bits.ones(starts[s] + at) - begin[s]
            out[todo] = np.where(bit[s], ones, at - ones)
        return out


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes, ordered by their first `depth` symbols at least, by doubling."""
    n, k = len(text), 1
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    while k < depth:
        key = (rank + 1) * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([False], key[order[1:]] != key[order[:-1]]))
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            return order
        k *= 2
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Of a text of symbols, for patterns of up to `depth` symbols; its last symbol is in no pattern."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        count = np.bincount(text)
        by = np.argsort(-count, kind="stable")
        self.number = np.empty(len(by), np.int64)
        self.number[by] = np.arange(len(by))
        own = self.number[text]
        self.depth, self.n = depth, len(text)
        order = sorted_suffixes(own, depth)
        self.tree = WaveletTree(own[order - 1])
        self.smaller = np.concatenate(([0], np.cumsum(np.sort(count)[::-1])))

    def matching_statistics(self, patterns: np.ndarray, ends: np.ndarray, times: int = 2) -> np.ndarray:
        """For each place in patterns, the length of the longest string that ends there and occurs `times` in the text.

        At most the index's depth, and as far as patterns goes back. Symbols of patterns occur in the text.
        """
        own = self.number[patterns]
        reached = np.zeros(len(ends), np.int64)
        todo, lo, hi = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        for k in range(self.depth):
            inside = ends[todo] >= k
            todo, lo, hi = todo[inside], lo[inside], hi[inside]
            if not len(todo):
                break
            symbol = own[ends[todo] - k]
            base = self.smaller[symbol]
            if k:
                both = self.tree.count(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
                lo, hi = base + both[: len(lo)], base + both[len(lo) :]
            else:
                lo, hi = base, self.smaller[symbol + 1]
            on = hi - lo >= times
            todo, lo, hi = todo[on], lo[on], hi[on]
            reached[todo] = k + 1
        return reached
