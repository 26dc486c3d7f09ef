"""Suffix arrays: what is sorted of contexts, and what comes of it."""

import random
from collections import Counter

import numpy as np

from phonospark.llm import suffix


def held(rows, length):
    """repeated_in against counting all windows; rows are (group, weight, place, context)."""
    rows = sorted(rows, key=lambda r: r[0])
    group, weight, place = (np.array([r[k] for r in rows]) for k in range(3))
    first, last = suffix.repeated_in(group, weight, place, [r[3] for r in rows], length)
    times = Counter()
    for g, n, p, c in rows:
        for i in range(len(c) - length + 1):
            times[g, p - i, c[i : i + length]] += n
    for (g, _, p, c), a, b in zip(rows, first.tolist(), last.tolist()):
        hit = [i for i in range(len(c) - length + 1) if times[g, p - i, c[i : i + length]] > 1]
        assert (a, b) == ((hit[0], hit[-1]) if hit else (-1, -1))
    return sum(first >= 0)


def contexts(rng, length, groups, of):
    """Contexts of anchors that agree with others of their group up to some place to each side."""
    room = length - suffix.GRAM
    for g in range(groups):
        gram, side = rng.randbytes(suffix.GRAM), [rng.randbytes(room) for _ in range(4)]
        seen = set()
        for _ in range(of):
            left, right = rng.randint(0, room), rng.randint(0, room)
            if left + right < room:
                continue
            halves = []
            for k, x in ((left, side[rng.randint(0, 1)]), (right, side[rng.randint(2, 3)])):
                same = rng.choice([0, k, rng.randint(0, k), rng.choice([41, 42, 43, 83, 84, 85, 125, 126, 127])])
                halves.append(x[: min(k, same)] + rng.randbytes(max(0, k - same)))
            c = halves[0][::-1] + gram + halves[1]
            if c not in seen:
                seen.add(c)
                yield g, rng.choice([1, 1, 1, 2]), left, c


def test_parts_give_the_same_windows():
    for seed in range(12):
        rng = random.Random(seed)
        assert held(list(contexts(rng, 200, 30, rng.randint(2, 30))), 200)
    assert held(list(contexts(random.Random(99), 48, 40, 12)), 48)


def test_contexts_without_a_common_window_are_not_sorted(monkeypatch):
    rng, sorted_bytes = random.Random(5), []
    arrays = suffix.suffix_arrays
    monkeypatch.setattr(suffix, "suffix_arrays", lambda t, begin, size: sorted_bytes.append(len(t)) or arrays(t, begin, size))
    gram, side = rng.randbytes(32), rng.randbytes(80)
    assert not held([(0, 1, 168, rng.randbytes(88) + side + gram + side + rng.randbytes(88)) for _ in range(50)], 200)
    assert not sum(sorted_bytes)
    # 100 common bytes to the left and 168 to the right: no more than the next step of 42 is sorted besides
    assert held([(0, 1, 168, rng.randbytes(68) + b"l" * 100 + gram + b"r" * 168) for _ in range(50)], 200) == 50
    assert sum(sorted_bytes) < 50 * (125 + 32 + 168 + 1) + 2
