"""The grammar on single tokens, and the same over columns."""

import pytest
from pyspark.sql import functions as F

from phonospark.functions import geometry as G
from phonospark.functions.automaton import Prefixes
from phonospark.functions import resolver as R
from phonospark.operators import resolve as O
from phonospark.sources.catalog import Catalog, ModelError

CASES = [  # token, status, path, a label it has
    ("p", "ok", "inventory", "bilabial"), ("tʃ", "ok", "inventory", None), ("t͡ʃ", "ok", "tie-stripped", None), ("d͡ʒ", "ok", "tie-stripped", None),
    ("pʰ", "ok", "diacritics", "aspirated"), ("aː", "ok", "diacritics", "long"), ("ã", "ok", "diacritics", "nasalized"), ("a⁵⁵", "ok", "diacritics", "tone-present"),
    ("ŋ̀", "ok", "diacritics", "syllabic"), ("ᵐb", "ok", "diacritics", "pre-nasalized"), ("ⁿdʳ", "ok", "diacritics", "rhotacized"), ("tʂʰ", "ok", "diacritics", "aspirated"),
    ("ai", "ok", "vowel-cluster", "diphthong"), ("əi³¹", "ok", "vowel-cluster", "tone-present"), ("aa", "ok", "vowel-cluster", "geminate"),
    ("kp", "ok", "complex", None), ("ɡb", "ok", "complex", None), ("mb", "ok", "complex", "pre-nasalized"), ("mbr", "ok", "consonant-cluster", None),
    ("³¹", "ok", "tone", "tonal-autosegment"), ("⁰", "ok", "tone", "tone-neutral"), ("˥˩", "ok", "tone", "tone-onset-5"),
    ("not-ipa", "unknown-grapheme", None, None), ("a¹²³⁴", "parse-error", None, None), ("aĭː", "parse-error", None, None), ("mb̆ː", "parse-error", None, None),
    ("<?>", "source-marker", None, None), ("+", "source-marker", None, None), ("<<->>", "source-marker", None, None), ("s̪̩̯", "parse-error", None, None),
    ("aːː", "ok", "diacritics", "ultra-long"), ("aːːː", "parse-error", None, None), ("x/ˈa", "ok", "inventory", "vowel"), ("n̪", "ok", "inventory", "dental"), ("d̪ʰ", "ok", "inventory", "aspirated"), ("", "unknown-grapheme", None, None),
]


@pytest.mark.parametrize("system", ["descriptive", "distinctive"])
def test_columns_equal_the_grammar(system, spark):
    c = Catalog.builtin()
    r = c.resolver(system)
    df = spark.createDataFrame([(t,) for t, *_ in CASES] + [(None,), ("p",)], "s string")
    got = {x.s: x for x in O.resolve(df, "s", c, system).collect()}
    assert got[None].status is None and O.resolve(df, "s", c, system).count() == len(CASES) + 2
    for token, status, path, label in CASES:
        one = r(token)
        assert got[token].status == status == (one if isinstance(one, str) else "ok"), token
        if status == "ok":
            assert got[token].r.path == one.path == path, token
            assert tuple(got[token].r.features) == one.features
            assert label is None or label in one.features


def test_a_place_mark_replaces_the_place():
    f = Catalog.builtin().resolver()("n̪").features
    assert "alveolar" not in f and {"dental", "anterior", "distributed"} <= set(f)


def test_valued_system(spark):
    c = Catalog.builtin().with_inventory("phoible", {"t̠ʃ": ("continuant=-", "spreadGlottis=-"), "p": ("labial=+", "spreadGlottis=-", "tone=0")})
    r = c.resolver("phoible")
    assert r("tʃ").path == "affricate-retracted"
    assert r("pʰ").features == ("labial=+", "spreadGlottis=+", "tone=0")
    assert r("³¹") == "unsupported-model" and r("p⁵⁵") == "unsupported-model"
    df = spark.createDataFrame([("pʰ",), ("³¹",)], "s string")
    seg = {x.s: x.v for x in O.resolve(df, "s", c, "phoible").select("s", O.is_segment(F.col("status")).alias("v")).collect()}
    assert seg == {"pʰ": True, "³¹": None}


def test_diagnose(spark):
    c = Catalog.builtin()
    df = spark.createDataFrame([("not-ipa",), ("pʰ",), ("a¹²³⁴",), ("tʃ@",), (None,)], "s string")
    for x in O.diagnose(df, "s", c).collect():
        if x.s is None:
            assert x.diagnosis is None
        else:
            assert tuple(x.diagnosis) == Prefixes(c.resolver()).diagnose(x.s)


def test_system_segment(spark):
    from phonospark.functions import strings as S

    df = spark.createDataFrame([("t͡ʃatʃka kpa",), ("ntʃa",), ("",)], "s string").withColumn("t", S.segment_ipa(F.col("s")))
    got = {x.s: x.segments for x in O.system_segment(df, "t", Catalog.builtin()).collect()}
    assert got == {"t͡ʃatʃka kpa": ["t͡ʃ", "a", "tʃ", "k", "a", "kp", "a"], "ntʃa": ["n", "tʃ", "a"], "": []}


HEAD = "@model toy\n@type categorical\n@geometry clements-hume\n"
ROW = "grapheme p consonant voiceless bilabial stop\n"
MODELS = [  # a model text, its status
    (HEAD + ROW, "ok"), (HEAD + "# note\n\n  " + ROW + "feature anything at all\n", "ok"), (ROW + "@type categorical\n@model toy", "ok"),
    (HEAD + "grapheme p\n", "parse-error"), (HEAD + "grapheme\n" + ROW, "parse-error"), (HEAD + ROW + "what\n", "parse-error"), (HEAD + ROW + "@what x\n", "parse-error"), (HEAD + ROW + "@modelx y\n", "parse-error"),
    (HEAD + ROW + "what\n@validation permissive\n", "ok"), (HEAD + ROW + "@validation lax\n", "parse-error"), (HEAD + ROW + "@validation\n", "parse-error"),
    (HEAD + ROW + ROW, "parse-error"), ("@validation permissive\n" + HEAD + ROW + ROW, "ok"), (HEAD + "grapheme \u02a7 stop voiceless\ngrapheme t\u0283 stop\n", "parse-error"),
    (HEAD + "grapheme p nonsense stop\n", "parse-error"), (HEAD + "grapheme p consonant\n", "parse-error"), ("@validation permissive\n" + HEAD + "grapheme q " + "x" * 600 + "\n", "ok"),
    (HEAD.replace("clements-hume", "other") + ROW, "unsupported-model"), (HEAD.replace("categorical", "valued") + ROW, "unsupported-model"), (HEAD + "@geometry\n" + ROW, "parse-error"),
    ("@type categorical\n" + ROW, "parse-error"), ("@model toy\n" + ROW, "parse-error"), (HEAD, "parse-error"), ("", "parse-error"), (HEAD + ROW[:9] + "\0" + ROW[9:], "parse-error"),
    ("@format_version 1\n" + HEAD + ROW, "ok"), ("@format_version 01\n" + HEAD + ROW, "ok"), ("@format_version 2\n" + HEAD + ROW, "unsupported-model"), ("@format_version 99999999999999999999999\n" + HEAD + ROW, "unsupported-model"),
    *((f"@format_version {v}\n" + HEAD + ROW, "parse-error") for v in ("0", "-1", "1.5", "one", "\u0661")),
]


@pytest.mark.parametrize("text, status", MODELS)
def test_model_texts(text, status):
    c = Catalog.builtin()
    if status == "ok":
        assert c.with_model(text).names() == ["descriptive", "distinctive", "toy"] and c.names() == ["descriptive", "distinctive"]
    else:
        with pytest.raises(ModelError) as e:
            c.with_model(text)
        assert e.value.status == status and str(e.value)


def test_models():
    c = Catalog.builtin()
    more = c.with_model(HEAD + "grapheme \u00e3 vowel open\ngrapheme \u02a7 stop voiceless\n")
    r = more.resolver("toy")
    assert r("a\u0303").features == ("vowel", "open") and r("t\u0283").features == ("stop", "voiceless") and r("b") == "unknown-grapheme"
    assert more.fingerprint("toy") == c.with_model("# other\n" + HEAD + "grapheme a\u0303 vowel open\ngrapheme \u02a7 stop voiceless\n").fingerprint("toy")
    wide = c.with_model("@validation permissive\n" + HEAD + "grapheme x " + " ".join(f"f{i:03}" for i in range(200)) + "\n")
    assert len(wide.resolver("toy")("x").features) == 200 and len(wide.fingerprint("toy")[1]) == 64
    rows = HEAD + "".join(f"grapheme q{i} consonant voiceless bilabial stop\n" for i in range(4000))
    with pytest.raises(ModelError, match="more than once: q0"):
        c.with_model(rows + "grapheme q0 stop\n")
    assert len(c.with_model(rows).inventories["toy"]) == 4000
    with pytest.raises(ModelError) as e:
        more.with_model(HEAD + ROW)
    assert e.value.status == "duplicate-name"
    manifest = {"name": "toy", "version": "1", "source": "s", "interpretation": "i", "license": "l"}
    assert c.with_model(HEAD + ROW, manifest).manifests["toy"] == manifest
    assert c.with_model(HEAD + ROW, manifest).fingerprint("toy") != c.with_model(HEAD + ROW).fingerprint("toy")
    for bad in ({**manifest, "name": "x"}, {k: v for k, v in manifest.items() if k != "interpretation"}):
        with pytest.raises(ModelError) as e:
            c.with_model(HEAD + ROW, bad)
        assert e.value.status == "invalid-argument"


def test_operation_fingerprints():
    c = Catalog.builtin()
    one = c.operation_fingerprint(tone_policy="split", b=1, a=2)
    assert one == c.operation_fingerprint(tone_policy="split", a=2, b=1) != c.operation_fingerprint(a=2, b=1) and len(one[1]) == 64
    assert c.operation_fingerprint("descriptive")[1] != c.operation_fingerprint("distinctive")[1]


def test_sql_functions(spark):
    from phonospark.functions.sql import register

    names = register(spark, Catalog.builtin())
    assert "phono_features" in names
    r = spark.sql("SELECT phono_status('p') s, phono_is_segment('??') i, phono_path('t\u0361\u0283') p, array_contains(phono_features('b'), 'voiced') f, phono_normalize('g') n, phono_bundle_distance(phono_bundle('p'), phono_bundle('b')) d, phono_status(NULL) z, phono_list_systems() l").first()
    assert (r.s, r.i, r.p, r.f, r.n, r.z, r.l) == ("ok", False, "tie-stripped", True, "\u0261", None, ["descriptive", "distinctive"]) and r.d == pytest.approx(0.1428571429, abs=1e-9)


def test_listed_spellings(spark):
    c = Catalog.builtin()
    inv = c.inventories["distinctive"]
    assert len(inv) == 769 == c.inventory(spark, "distinctive").count() and list(inv) == sorted(inv, key=str.encode)
    assert "sibilant" in inv["dʒ"] and "sibilant" not in inv["ⁿdʒ"] and "pre-nasalized" in inv["ⁿdʒ"]
    df = spark.createDataFrame([(["d", "̪ʰ", "a"],), (["n̪", "d̪", "a"],)], "t array<string>")
    assert [r.segments for r in O.system_segment(df, "t", c).collect()] == [["d̪ʰ", "a"], ["n̪", "d̪", "a"]]


def test_tables():
    assert len(G.leaves()) == 52 and len(G.dimensions()) == 54 and len(G.scales()) == 10 and len(G.feature_paths()) == 110
    assert len(R.decompositions()) == 386 and {s.name: s.width for s in G.builtin_systems().values()} == {"descriptive": 68, "distinctive": 64, "phoible": 38, "pbase-hc": 23, "pbase-spe": 25, "pbase-jfh": 15, "pbase-uftc": 44}
