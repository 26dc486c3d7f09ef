"""The grammar read from left to right: machines whose states are found as texts ask for them.

`Segmenter` joins orthographic tokens into the longest listed segments, `Prefixes` says which prefixes of a
token resolve. Both remember each step, so a text costs a look-up a character or token.
"""

from __future__ import annotations

import re
from functools import cache

from phonospark.functions import resolver as R
from phonospark.functions import tables

#: The most orthographic tokens that one segment spans, and how a segment resolves that tokens are joined for.
MAX_SPAN = 4
MERGING = ("inventory", "tie-stripped", "affricate-retracted", "complex")
STRESS = "ˈˌ"
#: ASCII characters that aren't tokens of their own.
SPECIAL = frozenset(" 012345")


@cache
def orthographic_pattern() -> re.Pattern:
    from phonospark.functions.strings import TOKEN

    return re.compile(TOKEN)


def orthographic(text: str) -> list[str]:
    """Tokens of a text as it is written."""
    if text.isascii() and SPECIAL.isdisjoint(text):
        return list(text)
    return orthographic_pattern().findall(R.segmentation_form(text))


class Trie:
    """Keys by their characters; nodes are numbered, the root is 0, and -1 is none."""

    def __init__(self, keys) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: set[int] = set()
        for key in keys:
            node = 0
            for c in key:
                node = self.next[node].setdefault(c, len(self.next))
                if node == len(self.next):
                    self.next.append({})
            self.ends.add(node)

    def walk(self, node: int, text: str) -> int:
        for c in text:
            if node < 0:
                break
            node = self.next[node].get(c, -1)
        return node


class Segmenter:
    """The longest-match automaton over one system's spellings.

    A state is a place in four tries at once: spellings as written and by source conventions, with ties and
    without. What follows a slash starts anew, and so does what follows stress at the start. Steps are by
    whole tokens, so a match ends where a token ends.
    """

    def __init__(self, resolve: R.Resolver) -> None:
        listed = list(resolve.inventory)
        retracted = [k for k in ("tʃ", "dʒ") if (got := resolve.lookup(k)) and got.path == "affricate-retracted"]
        combined = [k for k in R.COMPLEX if (got := resolve(k)) and isinstance(got, R.Resolution) and got.path in MERGING]
        as_is, bare, spelled = Trie(listed), Trie(listed + retracted), Trie(listed + retracted + combined)
        self.modes = ((as_is, False, False), (bare, False, True), (as_is, True, False), (spelled, True, True))
        self.places: list[tuple[int, ...]] = [(0,) * 4, (-1,) * 4]
        self.numbers = {p: i for i, p in enumerate(self.places)}
        self.accepts = [False, False]
        self.steps: list[dict[str, int]] = [{}, {}]

    def character(self, places: tuple[int, ...], c: str) -> tuple[int, ...]:
        if c == "/":
            return self.places[0]
        if c in STRESS and places == self.places[0]:
            return places
        whole = R.decompositions().get(c)
        out = []
        for node, (trie, conventions, no_ties) in zip(places, self.modes):
            text = whole or (R.CONVENTIONS.get(c, c) if conventions else c)
            out.append(trie.walk(node, text.translate({ord(t): None for t in R.TIES}) if no_ties else text))
        return tuple(out)

    def step(self, state: int, token: str) -> int:
        places = self.places[state]
        for c in token:
            places = self.character(places, c)
        to = self.numbers.get(places)
        if to is None:
            to = self.numbers[places] = len(self.places)
            self.places.append(places)
            self.steps.append({})
            self.accepts.append(any(p in trie.ends for p, (trie, *_) in zip(places, self.modes)))
        self.steps[state][token] = to
        return to

    def __call__(self, tokens: list[str]) -> list[str]:
        """The tokens, left to right, with the longest runs joined that the system lists as one segment."""
        steps, accepts, out, i, n = self.steps, self.accepts, [], 0, len(tokens)
        slash = any("/" in t for t in tokens)
        while i < n:
            state, size = 0, 1
            for k in range(i, min(i + MAX_SPAN, n)):
                to = steps[state].get(tokens[k])
                state = self.step(state, tokens[k]) if to is None else to
                if accepts[state]:
                    size = k - i + 1
                elif state == 1 and not slash:
                    break
            out.append(tokens[i] if size == 1 else "".join(tokens[i : i + size]))
            i += size
        return out


class Prefixes:
    """Which prefixes of a token resolve, in one pass.

    A state is what counts of the prefix: its characters after the last slash and without leading stress,
    each mark at most MARKS times after a letter (one more changes no status). Prefixes that hold a
    character which no spelling has, or more letters than any segment, are dead until the next slash.
    """

    MARKS, LETTERS = 4, 6

    def __init__(self, resolve: R.Resolver) -> None:
        self.resolve = resolve
        # stress may follow marks that have no letter yet
        self.marks = {*R.COMBINING, *R.SUFFIX, *R.SUFFIX_MORE, *R.PREFIX, *R.TONES, *tables.CHAO, *R.TIES, *STRESS}
        keys = [*resolve.inventory, *R.COMPLEX]
        self.known = self.marks | {c for k in keys for c in k} | set(tables.VOWEL_LETTERS)
        self.letters = max([self.LETTERS, *(sum(c not in self.marks for c in k) for k in keys)])
        self.keys, self.good, self.counts = ["", "\0"], [False, False], [0, 0]
        self.numbers = {"": 0}
        self.steps: dict[tuple[int, str], int] = {}

    def step(self, state: int, c: str) -> int:
        to = self.steps[state, c] = self._step(state, c)
        return to

    def _step(self, state: int, c: str) -> int:
        key = self.keys[state]
        if c == "/":
            return 0
        if state == 1 or c in STRESS and state == 0:
            return state
        if c in STRESS and self.counts[state]:
            return 1
        whole = R.decompositions().get(c)
        ways = [whole] if whole else [c, R.CONVENTIONS.get(c, c)]
        if not any(set(w) <= self.known for w in ways):
            return 1
        if c in self.marks:
            tail = len(key) - len(key.rstrip("".join(self.marks)))
            if key[len(key) - tail :].count(c) >= self.MARKS:
                return state
        count = self.counts[state] + min(sum(x not in self.marks for x in w) for w in ways)
        if count > self.letters:
            return 1
        key += c
        to = self.numbers.get(key)
        if to is None:
            to = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.counts.append(count)
            self.good.append(self.resolve.status(key) == R.OK)
        return to

    def longest(self, token: str) -> int:
        """Characters of the longest prefix that resolves, 0 for none."""
        steps, good, state, best = self.steps, self.good, 0, 0
        slash = "/" in token
        for i, c in enumerate(token, 1):
            to = steps.get((state, c))
            state = self.step(state, c) if to is None else to
            if good[state]:
                best = i
            elif state == 1 and not slash:
                break
        return best

    def diagnose(self, token: str) -> tuple[str, int, int, str]:
        """(status, bytes of the longest prefix that resolves, offset of what follows, that character)."""
        status = self.resolve.status(token)
        best = len(token) if status == R.OK else self.longest(token)
        n = len(token[:best].encode())
        return status, n, n, token[best : best + 1]
