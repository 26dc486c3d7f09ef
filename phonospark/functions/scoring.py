"""Vectors and distances as column expressions over feature arrays.

A feature array is encoded once into an array of doubles, one for each thing its scorer compares, with
null for what does not apply; a distance is then one pass over two such arrays and constant arrays of
weights. No shuffle and no Python.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from phonospark.functions import tables as T
from phonospark.functions.geometry import Scale, System, depth, feature_paths, knows, preset_weight

BINARY, ORDINAL, GROUP, VALUED = range(4)


def _any(f: Column, labels: tuple[str, ...]) -> Column:
    return F.arrays_overlap(f, F.array(*map(F.lit, labels))) if labels else F.lit(False)


def _level(f: Column, s: Scale) -> Column:
    out = None
    for i, x in enumerate(s.levels):
        test = F.array_contains(f, x)
        out = F.when(test, float(i)) if out is None else out.when(test, float(i))
    return out.otherwise(F.lit(None if s.default is None else float(s.default)).cast("double"))


def encode(f: Column, system: System) -> Column:
    """array<double>: binary +1, -1; the level of a scale; a group's labels as bits; null: nothing there."""
    out = []
    if system.scorer == "valued":
        for c, _ in system.columns:
            out.append(F.when(F.array_contains(f, f"{c}=+"), 1.0).when(F.array_contains(f, f"{c}=-"), -1.0).when(_any(f, (f"{c}=n", f"{c}=o", f"{c}=x")), 0.0))
        return F.array(*out)
    for d in system.binary:
        out.append(F.when(_any(f, d.positive), 1.0).when(_any(f, d.negative), -1.0))
    out += [_level(f, s) for s in system.ordinal]
    for _, labels in system.grouped:
        bits = F.lit(0.0)
        for i, x in enumerate(labels):
            bits = bits + F.when(F.array_contains(f, x), float(1 << i)).otherwise(0.0)
        out.append(F.when(bits > 0, bits))
    return F.array(*out)


def plan(system: System, preset: str | None = None) -> list[tuple[int, float, float]]:
    """(kind, weight, divisor) of each encoded place."""
    if system.scorer == "valued":
        return [(VALUED, preset_weight(d.node, d.weight, preset), 2.0) for d in system.binary]
    out = [(BINARY, preset_weight(d.node, d.weight, preset), d.divisor) for d in system.binary]
    out += [(ORDINAL, preset_weight(s.node, s.weight, preset), float(len(s.levels) - 1)) for s in system.ordinal]
    return out + [(GROUP, preset_weight(node, 1 / depth(node), preset), 1.0) for node, _ in system.grouped]


def compare(a: Column, b: Column, system: System, preset: str | None = None) -> Column:
    """struct(score, coverage) of two encoded arrays."""
    # one literal, parsed when the query is planned
    places = F.from_json(F.lit(json.dumps([{"k": k, "w": w, "d": d} for k, w, d in plan(system, preset)])), "array<struct<k:int,w:double,d:double>>")
    zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"), F.lit(0).alias("n"))
    paired = F.arrays_zip(a.alias("x"), b.alias("y"), places.alias("p"))

    def step(s: Column, e: Column) -> Column:
        x, y, p = e["x"], e["y"], e["p"]
        both, either = x.isNotNull() & y.isNotNull(), x.isNotNull() | y.isNotNull()
        one, two = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))
        used = F.when(p["k"] == VALUED, both & ((x != 0) | (y != 0))).when(p["k"] == ORDINAL, both).otherwise(either)
        delta = F.when(p["k"] == GROUP, F.when(one == two, 0.0).otherwise(1.0)).otherwise(F.abs(one - two) / p["d"])
        use = F.coalesce(used, F.lit(False))
        return F.when(use, F.struct((s["num"] + p["w"] * delta).alias("num"), (s["den"] + p["w"]).alias("den"), (s["n"] + 1).alias("n"))).otherwise(s)

    def finish(s: Column) -> Column:
        covered = s["n"] / F.lit(float(len(system.columns) or 1)) if system.scorer == "valued" else F.when(s["den"] > 0, 1.0).otherwise(0.0)
        return F.struct(F.when(s["den"] > 0, s["num"] / s["den"]).otherwise(0.0).alias("score"), covered.cast("double").alias("coverage"))

    return F.aggregate(paired, zero, step, finish)


def is_tone(f: Column) -> Column:
    return _any(f, ("tonal-autosegment", "tone=+"))


def let(x: Column, f) -> Column:
    """f(x) with x evaluated, and written into the plan, once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def prepare(r: Column, system: System) -> Column:
    """What distances read of a resolution (grapheme, features, components): encoded once for each type."""
    f = r["features"]
    return F.struct(
        r["grapheme"].alias("grapheme"),
        is_tone(f).alias("tone"),
        _any(f, ("long", "mid-long", "ultra-long")).alias("long"),
        F.array_contains(f, "geminate").alias("geminate"),
        encode(f, system).alias("e"),
        F.transform(r["components"], lambda c: encode(c["features"], system)).alias("parts"),
    )


def segment_distance(a: Column, b: Column, system: System, preset: str | None = None) -> Column:
    """struct(score, coverage, comparability) of two prepared resolutions.

    A tone against a segment costs a declared amount; segments of several parts are scored by parts and
    as a whole; coverage is always the scorer's, so equal spellings are scored like any pair.
    """

    def pair(score: Column, coverage: Column) -> Column:
        return F.struct(score.alias("score"), coverage.alias("coverage"))

    def mean(xs: Column, name: str) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x[name]) / F.greatest(F.size(xs), F.lit(1))

    def to_segment(cluster: Column, seg: Column) -> Column:
        def done(scores: Column) -> Column:
            first, rest, extra = F.get(scores, F.lit(0)), F.slice(scores, 2, 3), F.size(scores) - 1
            penalty = F.when(seg["long"] & cluster["geminate"], 0.0).otherwise(T.LENGTH_PENALTY * extra)
            s = T.NUCLEUS_SHARE * first["score"] + T.OFFGLIDE_SHARE * mean(rest, "score") + penalty
            c = (T.NUCLEUS_SHARE * first["coverage"] + T.OFFGLIDE_SHARE * mean(rest, "coverage")) / (T.NUCLEUS_SHARE + T.OFFGLIDE_SHARE)
            return pair(F.least(s, F.lit(1.0)), F.when(extra == 0, first["coverage"]).otherwise(c))

        return let(F.transform(cluster["parts"], lambda p: compare(p, seg["e"], system, preset)), done)

    def to_cluster() -> Column:
        common = F.least(F.size(a["parts"]), F.size(b["parts"]))
        each = F.zip_with(F.slice(a["parts"], 1, common), F.slice(b["parts"], 1, common), lambda x, y: compare(x, y, system, preset))
        spare = F.abs(F.size(a["parts"]) - F.size(b["parts"]))
        return let(each, lambda xs: pair(F.least(mean(xs, "score") + T.LENGTH_PENALTY * spare, F.lit(1.0)), mean(xs, "coverage")))

    def joint(whole: Column) -> Column:
        parts = F.when(F.size(b["parts"]) == 0, to_segment(a, b)).when(F.size(a["parts"]) == 0, to_segment(b, a)).otherwise(to_cluster())
        score = lambda p: F.least(T.COMPONENT_SHARE * p["score"] + T.SEGMENT_SHARE * whole["score"], F.lit(1.0))
        covered = lambda p: (T.COMPONENT_SHARE * p["coverage"] + T.SEGMENT_SHARE * whole["coverage"]) / (T.COMPONENT_SHARE + T.SEGMENT_SHARE)
        many = (F.size(a["parts"]) > 0) | (F.size(b["parts"]) > 0)
        return F.when(many, let(parts, lambda p: pair(score(p), covered(p)))).otherwise(whole)

    tier = a["tone"] != b["tone"]
    got = F.when(tier, pair(F.lit(T.CROSS_TIER_COST), F.lit(0.0))).otherwise(let(compare(a["e"], b["e"], system, preset), joint))
    same = (a["grapheme"] == b["grapheme"]) & ~tier

    def told(g: Column) -> Column:
        why = F.when(tier, "cross-tier").when(g["coverage"] == 0, "no-shared-dimension").otherwise("ok")
        # equal spellings are at no distance, whatever their parts' penalties would say
        return F.struct(F.when(same, 0.0).otherwise(g["score"]).alias("score"), g["coverage"].alias("coverage"), why.alias("comparability"))

    return let(got, told)


def sound_distance(a: Column, b: Column, leaf_system: System, preset: str | None = None) -> Column:
    """struct(status, score) of two raw label sets by the leaf scorer; unknown labels are refused."""
    labels = [x for x in {*feature_paths(), *T.METADATA, *(x for s in leaf_system.ordinal for x in s.levels), *(x for _, g in leaf_system.grouped for x in g)} if knows(x)]
    known = F.array(*map(F.lit, sorted(labels)))
    prefixed = "^(?:" + "|".join(T.METADATA_PREFIXES) + ")"
    good = F.forall(F.concat(a, b), lambda x: F.array_contains(known, x) | x.rlike(prefixed))
    return F.struct(F.when(good, "ok").otherwise("unknown-feature").alias("status"), F.when(good, compare(encode(a, leaf_system), encode(b, leaf_system), leaf_system, preset)["score"]).alias("score"))


def feature_distance(a: Column, b: Column) -> Column:
    """Hops between two labels in the tree, by their common path; null for labels off the tree."""
    paths = F.create_map(*(x for k, v in feature_paths().items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    x, y = F.element_at(paths, a), F.element_at(paths, b)
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct(F.when(s["on"] & e, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    return F.when(x.isNotNull() & y.isNotNull(), F.size(x) + F.size(y) - 2 * same)


def vector(f: Column, system: System) -> Column:
    """array<double> of fixed width: +1, -1, 0; the k-th of n levels as k/n; unknown values NaN."""
    if system.scorer == "valued":
        return F.array(*(F.when(F.array_contains(f, f"{c}=+"), 1.0).when(F.array_contains(f, f"{c}=-"), -1.0).when(F.array_contains(f, f"{c}=?"), float("nan")).otherwise(0.0) for c, _ in system.columns))
    out = [F.when(_any(f, d.positive), 1.0).when(_any(f, d.negative), -1.0).otherwise(0.0) for d in system.binary]
    out += [F.coalesce((_level(f, s) + 1) / float(len(s.levels)), F.lit(0.0)) for s in system.ordinal]
    for _, labels in system.grouped:
        out += [F.when(F.array_contains(f, x), 1.0).when(_any(f, labels), -1.0).otherwise(0.0) for x in labels]
    return F.array(*out)


def fixed_space_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two vectors; NaN stays NaN."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)
