"""The automata against plain readings: every span joined and resolved, every prefix resolved."""

import random

import pytest

from phonospark.functions import resolver as R
from phonospark.functions import tables
from phonospark.functions.automaton import MERGING, Prefixes, Segmenter, orthographic
from phonospark.sources.catalog import Catalog

ROWS = "grapheme p consonant voiceless bilabial stop\ngrapheme t͡s consonant alveolar affricate voiceless\ngrapheme s consonant alveolar fricative\ngrapheme t consonant stop alveolar\ngrapheme t̠ʃ consonant affricate\ngrapheme ʃ consonant fricative\ngrapheme aaa vowel open front\ngrapheme a vowel open front\ngrapheme aː vowel open front long\ngrapheme papapa consonant stop\n"
CATALOG = Catalog.builtin().with_model("@model toy\n@type categorical\n@geometry clements-hume\n@validation permissive\n" + ROWS)
SYSTEMS = ["distinctive", "descriptive", "toy"]
#: Letters, marks of all kinds, tones, ties, source spellings, slashes, stress and what nothing reads.
CHARS = "ptkdsʃʒaaiuəy̯bmnŋgxéüñçßʰːːʷ́̀̈͜͡ⁿ̩̃²³⁰⁵5/ˈˌ+ .ʦɡ:'ǝɫ<>_#Qᵐ"


def texts(seed, n, chars=CHARS, most=9):
    rng = random.Random(seed)
    return ["".join(rng.choice(chars) for _ in range(rng.randrange(most))) for _ in range(n)]


def joined(resolve, tokens):
    out, i = [], 0
    while i < len(tokens):
        for n in range(min(4, len(tokens) - i), 0, -1):
            got = resolve("".join(tokens[i : i + n])) if n > 1 else None
            if n == 1 or isinstance(got, R.Resolution) and got.path in MERGING:
                break
        out.append("".join(tokens[i : i + n]))
        i += n
    return out


@pytest.mark.parametrize("system", SYSTEMS)
@pytest.mark.parametrize("chars", [CHARS, "tsʃdʒa/", "tsdzʃ͡ʰ/ˈ", "papt͡sː", "mbndŋgkpxʦɡ"])
def test_segments(system, chars):
    resolve = CATALOG.resolver(system)
    read, merged = Segmenter(resolve), 0
    for t in texts(1, 3000, chars, 12):
        tokens = orthographic(t)
        want = joined(resolve, tokens)
        assert read(tokens) == want, t
        merged += len(want) < len(tokens)
    assert merged > 20 or system == "toy"


def test_segments_of_tokens_that_no_text_has():
    resolve = CATALOG.resolver()
    read, rng = Segmenter(resolve), random.Random(2)
    parts = ["d", "̪ʰ", "", "t", "͡", "s", "ʰ", "/", "ts", "a/", "ˈ", "n", "ˈt", "ʃ"]
    for _ in range(4000):
        tokens = [rng.choice(parts) for _ in range(rng.randrange(8))]
        assert read(tokens) == joined(resolve, tokens), tokens


def plain_diagnosis(resolve, token):
    status = resolve.status(token)
    best = len(token) if status == R.OK else max((i for i in range(1, len(token) + 1) if resolve.status(token[:i]) == R.OK), default=0)
    n = len(token[:best].encode())
    return status, n, n, token[best : best + 1]


@pytest.mark.parametrize("system", SYSTEMS)
@pytest.mark.parametrize("chars", [CHARS, "aiuː́̀²⁵/", "ptkʰʷ͡/ˈ", "aéüː", "<>a_#+/", "¹²³a", "pa"])
def test_prefixes(system, chars):
    resolve = CATALOG.resolver(system)
    read = Prefixes(resolve)
    for t in texts(3, 2500, chars, 12) + [f"a{c * n}i" for c in "ːʰ̃²́" for n in range(1, 9)] + [f"{c * n}p" for c in "ʰᵐ" for n in range(9)]:
        assert read.diagnose(t) == plain_diagnosis(resolve, t), t


def test_prefixes_are_linear():
    read = Prefixes(CATALOG.resolver())
    before = len(read.keys)
    for t in ("aː" * 20_000, "p" + "ʰ̃" * 20_000, "x/" * 20_000 + "a", "the" * 20_000):
        read.longest(t)
    assert len(read.keys) - before < 200
    assert read.diagnose("x/" * 5000 + "ab")[1] == 10_001


@pytest.mark.parametrize("system", SYSTEMS)
def test_marks_that_are_known_count_as_marks(system):
    read = Prefixes(CATALOG.resolver(system))
    assert read.letters >= Prefixes.LETTERS and set(tables.CHAO) <= read.marks
