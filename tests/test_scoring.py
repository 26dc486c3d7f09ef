"""Distances with known values, strings, bundles against enumeration, alignment."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from phonospark.functions import bundles as B
from phonospark.functions import geometry as G
from phonospark.functions import scoring as S
from phonospark.functions import strings as St
from phonospark.operators import alignment, corpus, typology
from phonospark.operators import bundles as OB
from phonospark.sources.catalog import Catalog

HOPS = [("voiced", "voiceless", 2), ("voiced", "voiced", 0), ("nasal", "lateral", 4), ("advanced", "coronal", 5), ("advanced", "consonantal", 6), ("advanced", "palatalized", 8), ("stop", "stop", None)]


@pytest.fixture(scope="module")
def distances(spark):
    tokens = spark.createDataFrame([(x,) for x in "p b a i aː aa ai ia ³¹ ⁵⁵ ŋ g kp".split()], "token string")
    return {(r.a, r.b): r for r in typology.distances(tokens, Catalog.builtin()).collect()}


def test_distances(distances):
    assert distances["p", "b"].score == pytest.approx(0.1428571429, abs=1e-9)
    assert distances["p", "p"].score == 0 and distances["p", "p"].coverage == 1
    assert distances["a", "³¹"] == ("a", "³¹", 1.0, 0.0, "cross-tier")
    assert all(distances[a, b].score == pytest.approx(distances[b, a].score) and 0 <= distances[a, b].score <= 1 for a, b in distances)


def test_clusters(distances):
    assert distances["ai", "ai"].score == 0 and distances["ai", "ia"].score > 0
    assert distances["aa", "aː"].score < distances["ai", "aː"].score  # a doubled vowel pays no penalty against a long one


def test_hops(spark):
    df = spark.createDataFrame(HOPS, "a string, b string, d int")
    assert all(r.d == r.v for r in df.withColumn("v", S.feature_distance(F.col("a"), F.col("b"))).collect())


def test_presets():
    assert G.preset_weight("Release", 1.0, "tone-only") == 0 and G.preset_weight("TonalMid", 0.4, "tone-heavy") == 0.8 and G.preset_weight("Root", 0.3, "flat") == 1
    with pytest.raises(G.UnknownPreset):
        G.preset_weight("Root", 1.0, "no such")


def test_unknown_label(spark):
    df = spark.createDataFrame([(["voiced"], ["nonsense"])], "a array<string>, b array<string>")
    assert df.select(S.sound_distance(F.col("a"), F.col("b"), G.builtin_systems()["descriptive"]).alias("r")).first().r == ("unknown-feature", None)


def test_tokens_and_tone(spark):
    df = spark.createDataFrame([("t͡ʃa55",), ("ʰta.ka+ŋ²¹ a⁰",), ("²¹³",), ("ma5 n4",), (None,)], "s string").withColumn("t", St.segment_ipa(F.col("s"))).withColumn("m", St.merge_tone_digits(F.col("t")))
    got = {r.s: (r.t, r.m) for r in df.collect()}
    assert got["t͡ʃa55"] == (["t͡ʃ", "a", "⁵⁵"], ["t͡ʃ", "a⁵⁵"])
    assert got["ʰta.ka+ŋ²¹ a⁰"][0] == ["ʰt", "a", ".", "k", "a", "+", "ŋ", "²¹", "a", "⁰"] == got["ʰta.ka+ŋ²¹ a⁰"][1]
    assert got["ma5 n4"][1] == ["m", "a⁵⁴", "n"] and got[None] == (None, None)
    split = {r.s: tuple(r.x) for r in spark.createDataFrame([("a³³",), ("³³",), ("a",)], "s string").withColumn("x", St.split_tone(F.col("s"))).collect()}
    assert split == {"a³³": ("ok", "a", "³³"), "³³": ("unknown-grapheme", None, None), "a": ("ok", "a", None)}


def test_vectors(spark):
    c = Catalog.builtin()
    for name in ("descriptive", "distinctive"):
        s = c.system(name)
        v = spark.createDataFrame([(list(c.inventories[name]["a"]),)], "f array<string>").select(S.vector(F.col("f"), s).alias("v")).first().v
        assert len(v) == s.width == len(s.vector_labels())


def brute(system, a, b):
    """Least and greatest distance over all completions of a few open cells."""
    cols = B.columns(system)

    def completions(col, c):
        out = [B.Cell(True)] * c.na
        if col.kind == "group":
            full = range(1, 1 << len(col.labels))
            masks = full if c.any else [1 << i for i in range(len(col.labels)) if c.mask >> i & 1] if c.oneof else [c.mask] if c.mask else []
            return out + [B.Cell(mask=m) for m in masks]
        return out + [B.Cell(mask=1 << i) for i in range(8) if c.mask >> i & 1]

    values = [B.compare(system, x, y)["distance"] for x in itertools.product(*map(completions, cols, a)) for y in itertools.product(*map(completions, cols, b))]
    return min(values), max(values)


def test_bundle_bounds_are_exact():
    s = Catalog.builtin().system("distinctive")
    inv, rng = Catalog.builtin().inventories["distinctive"], random.Random(3)
    for _ in range(12):
        x, y = (tuple(B.of_features(c, inv[rng.choice(list(inv))]) for c in B.columns(s)) for _ in range(2))
        a = B.with_cells(s, x, **{B.columns(s)[rng.randrange(54)].name: rng.choice(["*", "?"]) for _ in range(3)}, vowel_height="close..mid|0")
        got = B.compare(s, a, y)
        assert (got["minimum"], got["maximum"]) == pytest.approx(brute(s, a, y), abs=1e-12)
        assert B.parse(s, B.text(s, a)) == a and B.compatible(s, a, a)


def test_bundles_in_columns(spark):
    c = Catalog.builtin()
    df = OB.from_graphemes(spark.createDataFrame([("p",), ("b",), ("ai",), ("??",)], "g string"), "g", c)
    got = {r.g: r for r in df.collect()}
    assert got["ai"].bundle_status == "unsupported-model" and got["??"].bundle is None
    pair = spark.createDataFrame([(got["p"].bundle, got["b"].bundle)], "a string, b string")
    r = OB.compare(pair, "a", "b", c).first().comparison
    assert r.distance == pytest.approx(0.1428571429, abs=1e-9) == r.minimum == r.maximum and not r.compatible
    cover = OB.covering(df.where("bundle IS NOT NULL").selectExpr("'k' AS k", "bundle"), "k", "bundle", c).first().bundle
    near = OB.compatible_graphemes(spark.createDataFrame([(cover,)], "bundle string"), "bundle", c).orderBy("rank").collect()
    assert {"p", "b"} <= {x.grapheme for x in near}


def test_alignment(spark):
    costs = spark.createDataFrame([(a, b, 0.2 if {a, b} == {"t", "d"} else 0.9) for a in "tdao" for b in "tdao" if a != b], "a string, b string, score double")
    pairs = spark.createDataFrame([(list("tao"), list("da"), [(0, 0), (1, 1), (2, -1)]), (list("ta"), list("ta"), [(0, 0), (1, 1)])], f"s1 array<string>, s2 array<string>, gold {alignment.COLUMNS}")
    got = alignment.evaluate(alignment.align(pairs, costs, 0.4)).first()
    assert got.column_accuracy == 1 and got.perfect == 1 and alignment.tune_gap(pairs, costs, (0.3, 0.4)) == 0.3
    assert alignment.readable_pairs(pairs, spark.createDataFrame([("t",), ("a",)], "token string")).count() == 1


def test_audits(spark):
    c = Catalog.builtin()
    inv = c.inventory(spark, "distinctive")
    assert corpus.model_violations(inv, c.system()).count() == 0
    few = inv.where("grapheme IN ('p', 'b')")
    none = {r.dimension for r in corpus.unreachable(c, few, "distinctive").collect()}
    set_ = {d.name for d in c.system().binary if set(d.positive + d.negative) & {x for r in few.collect() for x in r.features}}
    assert "vowel_height" in none and not none & set_ and none | set_ >= {d.name for d in c.system().binary}
    assert {r.label for r in corpus.dead_labels(c, inv.unionByName(spark.createDataFrame([("distinctive", "x", ["nonsense", "stop"], 0)], inv.schema)), "distinctive").collect()} >= {"nonsense"}
    t = spark.createDataFrame([("⁵¹",), ("¹⁵",), ("⁵",), ("⁵⁵",), ("³",)], "token string")
    cost = {(r.a, r.b): r.cost for r in corpus.tone_costs(t).collect()}
    assert cost["⁵¹", "¹⁵"] == 1.0 and cost["⁵", "⁵¹"] == 0.5 and cost["⁵", "⁵⁵"] == 0 and cost["³", "⁵"] == 0.5 and len(cost) == 25


def test_floors_and_shrinkage(spark):
    m = spark.createDataFrame([("x", 100, 90, 1000, 905), ("y", 100, 99, 1000, 999)], "system string, types long, types_read long, tokens long, tokens_read long")
    floors = spark.createDataFrame([("x", 90.0, 91.0), ("y", 99.0, 99.9)], "system string, types_floor double, tokens_floor double")
    assert [r.system for r in corpus.below_floor(m, floors).collect()] == ["x"]
    r = spark.sql("SELECT 5L AS n, 0.2D AS f, 0.8D AS p").select(corpus.shrunk(F.col("n"), F.col("f"), F.col("p")).alias("a"), corpus.shrunk(F.lit(None), F.lit(None), F.col("p")).alias("b")).first()
    assert r.a == pytest.approx(0.5) and r.b == 0.8


def test_bootstrap():
    x, y = [1.0, 0.5, 0.0, 1.0, 0.25], [0.5, 0.5, 0.25, 0.0, 0.25]
    rng, means, d = random.Random(7), [], [p - q for p, q in zip(x, y)]
    for _ in range(400):
        draw = [d[rng.randrange(5)] for _ in range(5)]
        means.append(sum(draw) / 5)
    means.sort()
    assert alignment.bootstrap(x, y) == pytest.approx((0.25, means[10], means[390]))


def test_equivalent_spellings(spark):
    same = [("⁵", "⁵⁵⁵"), ("⁵¹", "˥˩"), ("⁵³¹", "⁵¹")]
    other = [("⁵", "⁴"), ("a⁵", "a⁵"), ("⁰", "⁰"), ("¹²³⁴", "¹²³⁴")]
    df = spark.createDataFrame(same + other, "a string, b string").select(F.coalesce(St.contour(F.col("a")) == St.contour(F.col("b")), F.lit(False)).alias("same"))
    assert [r.same for r in df.collect()] == [True] * 3 + [False] * 4
    marks = [("t̪ʷʰ", "t̪ʰʷ", True), ("t̪ʰ", "t̪ʰʰ", True), ("ʰt", "tʰ", False), ("aː", "aːː", False), ("ŋ̊", "ŋ̥", True), ("k'", "kʼ", True), ("tsʰ", "tʰs", False)]
    got = spark.createDataFrame(marks, "a string, b string, same boolean").select("same", (St.marks_key(F.col("a")) == St.marks_key(F.col("b"))).alias("got")).collect()
    assert all(bool(r.got) == r.same for r in got)


def test_contrast_baseline(spark):
    c = Catalog.builtin()
    t = spark.createDataFrame([(x,) for x in ("⁵", "⁵⁵", "pʰʷ", "pʷʰ", "p", "b", "??", "⁴")], "token string")
    got = {(r.a, r.b): r.status for r in corpus.contrast_baseline(t, c, declared=spark.createDataFrame([("pʰʷ", "pʷʰ")], "a string, b string")).collect()}
    assert got == {("⁵", "⁵⁵"): "spelling-equivalent", ("pʰʷ", "pʷʰ"): "declared"}
    assert corpus.contrast_baseline(t, c, most=3).count() <= 1
    forms = {r.token for r in corpus.composed_forms(c.inventory(spark, "distinctive"), 10).collect()}
    assert len(forms) == 300 and any(f.startswith("ᵐ") for f in forms)


GOLD = f"family string, s1 array<string>, s2 array<string>, gold {alignment.COLUMNS}"


def families():
    """Two families in which t answers d, and one in which it doesn't."""
    one = lambda f, x, y: (f, ["a", x, "o"], ["a", y, "o"], [(0, 0), (1, 1), (2, 2)])
    return [one("A", "t", "d") for _ in range(12)] + [one("B", "t", "d") for _ in range(12)] + [("C", ["t", "a"], ["a", "d"], [(0, -1), (1, 0), (-1, 1)])]


def test_leave_one_out(spark):
    pairs = spark.createDataFrame(families(), GOLD)
    base = spark.createDataFrame([(a, b, 0.0 if a == b else 0.9) for a in "tdao" for b in "tdao"], "a string, b string, score double")
    rows = {r.held: r for r in corpus.leave_one_out(pairs, base).collect()}
    assert set(rows) == {"A", "B", "C"} and all(r.change == pytest.approx(r.accuracy_fitted - r.accuracy_base) for r in rows.values())
    # what A is tested with comes from B and C: of 72 + 2 places t and d have 12 each
    fit = corpus.pair_costs(spark.createDataFrame([("a", "a")] * 13 + [("o", "o")] * 12 + [("t", "d")] * 12, "x string, y string"))
    cost = {(r.a, r.b): r.cost for r in fit.collect()}
    assert cost["a", "a"] == cost["o", "o"] == 0 and cost["d", "t"] == pytest.approx(1 / (1 + (12 / 74) / (12 * 12 / 74**2)))
    assert rows["A"].accuracy_base == rows["A"].accuracy_fitted == 1.0 and rows["A"].calibration_base is not None


def test_calibration_gap(spark):
    b = spark.createDataFrame([(0, 30, 0.05, 1.0), (9, 30, 0.95, 0.25)], "bin long, n long, mean_score double, rate double")
    assert corpus.calibration_gap(b).first().gap == pytest.approx((abs(0.95 - 1) + abs(0.05 - 0.25)) / 2)


def test_tone_sweep(spark):
    gold = [(["m", "a", "⁵"], ["m", "a", "⁵⁵"], [(0, 0), (1, 1), (2, 2)]), (["a", "⁵"], ["a", "n"], [(0, 0), (1, -1), (-1, 1)])]
    pairs = spark.createDataFrame(gold, f"s1 array<string>, s2 array<string>, gold {alignment.COLUMNS}")
    base = spark.createDataFrame([(a, b, 0.0 if a == b else 0.9) for a in "man" for b in "man"], "a string, b string, score double")
    tones = spark.createDataFrame([("⁵",), ("⁵⁵",)], "token string")
    rows = {r.target: r for r in corpus.tone_sweep(pairs, pairs, base, tones, targets=(0.3, 1.0, 2.0), gaps=(0.4,)).collect()}
    assert rows[0.3].test_accuracy < 1 and rows[1.0].test_perfect == rows[2.0].test_perfect == 1 and [rows[t].saturated for t in (0.3, 1.0, 2.0)] == [False, True, True]


def test_alignment_costs_beyond_the_broadcast(spark, monkeypatch):
    costs = spark.createDataFrame([(a, b, 0.2 if {a, b} == {"t", "d"} else 0.9) for a in "tdao" for b in "tdao" if a != b], "a string, b string, score double")
    pairs = spark.createDataFrame([(list("tao"), list("da")), (list("ta"), list("ta")), ([], ["a"])], "s1 array<string>, s2 array<string>")
    rows = lambda: sorted(map(repr, alignment.align(pairs, costs, 0.4).collect()))
    few = rows()
    monkeypatch.setattr(alignment, "BROADCAST_COSTS", 1)
    assert rows() == few


def test_geometry_of_the_users_own(spark):
    import json

    from phonospark.functions import altgeometry as A

    tree = {"name": "Root", "children": [{"name": "Laryngeal", "children": [{"positive": "voiced", "negative": "voiceless", "weight": 2.0}]}, {"positive": "nasal"}]}
    text = json.dumps({"tree": tree, "feature_to_node": {"click": "Root"}, "ordinal_scales": [{"name": "h", "node": "Root", "levels": ["low", "mid", "high"]}], "weight_presets": {"quiet": {"Laryngeal": 0.0}}})
    g = A.Geometry.read(text)
    df = spark.createDataFrame([(["voiced", "low"], ["voiceless", "high"]), (["voiced"], ["voiced", "click"])], "a array<string>, b array<string>")
    got = [(r.d, r.q) for r in df.select(A.distance(F.col("a"), F.col("b"), g).alias("d"), A.distance(F.col("a"), F.col("b"), g, "quiet").alias("q")).collect()]
    assert got == [pytest.approx(((2 + 1) / (2 + 1 + 1), 1 / 2)), pytest.approx((0.5 / 4, 0.5 / 2))]
    for change in ({"feature_to_node": {"x": "Nowhere"}}, {"ordinal_scales": [{"name": "h", "node": "Root", "levels": ["one"]}]}, {"weight_presets": {"p": {"Nowhere": 1}}}, {"weight_presets": {"p": {"Root": -1}}}, {"weight_presets": {"p": {"Root": "1"}}}):
        with pytest.raises(ValueError):
            A.Geometry.read(json.dumps({**json.loads(text), **change}))


def test_fixed_space(spark):
    r = spark.sql("SELECT array(1D, 0D, -1D) a, array(0D, 0D, 1D) b").select(S.fixed_space_distance(F.col("a"), F.col("b")).alias("d")).first()
    assert r.d == pytest.approx(1.0)
