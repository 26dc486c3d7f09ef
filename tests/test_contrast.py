"""Pairs at distance zero against all pairs."""

import pytest

from phonospark.operators import corpus, typology
from phonospark.sources.catalog import Catalog

COARSE = "@model coarse\n@type categorical\n@geometry clements-hume\n@validation permissive\n" + "".join(f"grapheme {g} {f}\n" for g, f in {"a": "vowel open", "e": "vowel close-mid", "i": "vowel close", "u": "vowel", "y": "vowel long", "p": "consonant stop", "t": "consonant stop", "b": "consonant stop voiced", "s": "consonant fricative"}.items())
VALUED = {"p": ("a=+", "b=-"), "t": ("a=+", "b=0"), "k": ("a=+", "b=-"), "s": ("a=0", "b=-"), "x": ("a=n", "b=-"), "o": ("a=0", "b=0"), "z": ("a=-", "b=?")}


def all_pairs(tokens, c, system):
    d = typology.distances(tokens, c, system).where("a < b AND score = 0")
    return sorted((r.a, r.b, r.comparability) for r in d.collect())


@pytest.mark.parametrize("system", ["distinctive", "descriptive", "coarse", "phoible"])
def test_zero_pairs_are_all(spark, system):
    valued = {g: tuple(f"{n}={x.split('=')[1]}" for n, x in zip(("labial", "coronal"), f)) for g, f in VALUED.items()}
    c = Catalog.builtin().with_model(COARSE).with_inventory("phoible", valued)
    inv = c.inventory(spark, "distinctive").select("grapheme").toDF("token")
    more = spark.createDataFrame([(x,) for x in "t͡s ts t͡ʃ pʰʷ pʷʰ tʰʰ ai aːi aa aː mb ˥ ⁵⁵ ⁵ qq aĭ aí aì á à ã".split()], "token string")
    tokens = more.union(corpus.bare_forms(spark)).union(corpus.composed_forms(c.inventory(spark, "distinctive"), 5))
    tokens = tokens.union(inv) if system == "descriptive" else tokens.union(inv.limit(150)).union(spark.createDataFrame([(x,) for x in "aeiuyptbskxoz"], "token string"))
    want = all_pairs(tokens, c, system)
    assert sorted(map(tuple, corpus.zero_pairs(tokens, c, system).collect())) == want and len(want) > 3


def test_bare_forms(spark):
    forms = {r.token for r in corpus.bare_forms(spark).collect()}
    assert len(forms) == 5 + 25 + 125 + 9 + 36 and {"¹²³", "˧˥", "⁰", "ai̯", "mb"} <= forms
    c = Catalog.builtin()
    status = {(r.a, r.b): r.status for r in corpus.contrast_baseline(corpus.bare_forms(spark), c).collect()}
    assert status["¹", "¹¹"] == "spelling-equivalent" and status["˥", "⁵"] == "spelling-equivalent"


def test_labels_and_provenance(spark):
    inv = spark.createDataFrame([("p", ["consonant", "voiceless", "what"]), ("a", ["vowel", "open", "n1-open"])], "grapheme string, features array<string>")
    got = {r.label: (r.kind, r.node, r.depth) for r in corpus.label_reach(inv).collect()}
    assert got["voiceless"] == ("scored", "Laryngeal", 1) and got["what"] == ("unknown", None, None) and got["vowel"][0] == "metadata"
    cut = {r.label: r.kind for r in corpus.label_reach(inv, [("Place", "Root")]).collect()}
    assert cut["voiceless"] == "unreachable"
    declared = corpus.row_hashes(inv)
    assert corpus.provenance_violations(inv, declared).count() == 0
    other = spark.createDataFrame([("p", ["voiced"]), ("t", ["stop"])], "grapheme string, features array<string>")
    assert {tuple(r) for r in corpus.provenance_violations(other, declared).collect()} == {("p", "changed"), ("t", "undeclared"), ("a", "missing")}
