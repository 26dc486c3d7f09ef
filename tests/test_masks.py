"""Compiled bundles against the functions on one pair of bundles."""

import random

import pytest
from pyspark.sql import functions as F

from phonospark.functions import bundles as B
from phonospark.functions import masks as M
from phonospark.operators import bundles as OB
from phonospark.sources.catalog import Catalog

VALUED = {"p": ("labial=+", "coronal=-", "tone=0"), "t": ("labial=-", "coronal=+", "sonorant=n"), "k": ("labial=?", "coronal=x"), "a": ()}
CATALOG = Catalog.builtin().with_inventory("phoible", VALUED)


def random_bundles(system, n, seed):
    rng, cols = random.Random(seed), B.columns(system)
    out = []
    for _ in range(n):
        parts = []
        for c in rng.sample(cols, rng.randrange(len(cols) + 1)):
            ways = ["*", "?", "0"]
            if c.kind == "binary":
                ways += ["+", "-", "+|-", "+|0"] + (["n", "+|n"] if c.valued else [])
            elif c.kind == "ordinal":
                ways += [*c.labels, f"{c.labels[0]}..{c.labels[-1]}", f"{c.labels[0]}|0"]
            else:
                ways += [c.labels[0], "&".join(c.labels[:2]), "|".join(c.labels[:2]), f"{c.labels[-1]}|0", f"?|{c.labels[0]}"]
            parts.append(f"{c.name}={rng.choice(ways)}")
        out.append(";".join(parts))
    return out


@pytest.mark.parametrize("name", ["distinctive", "descriptive", "phoible"])
def test_pairs(spark, name):
    s = CATALOG.system(name)
    texts = random_bundles(s, 60, 1) + [B.text(s, tuple(B.of_features(c, f) for c in B.columns(s))) for f in list(CATALOG.inventories[name].values())[::40]]
    rng = random.Random(2)
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", M.of_text(F.col("a"), s).alias("x"), M.of_text(F.col("b"), s).alias("y"))
    allowed = 0
    for r in df.select("a", "b", M.compatible(F.col("x"), F.col("y"), s).alias("c"), M.distance(F.col("x"), F.col("y"), s).alias("d")).collect():
        p, q = B.parse(s, r.a), B.parse(s, r.b)
        assert r.c == B.compatible(s, p, q), (r.a, r.b)
        assert r.d == pytest.approx(B.compare(s, p, q)["distance"], abs=1e-12), (r.a, r.b)
        allowed += r.c
    assert allowed > 10


@pytest.mark.parametrize("name", ["distinctive", "descriptive", "phoible"])
def test_features(spark, name):
    s = CATALOG.system(name)
    inv = CATALOG.inventory(spark, name)
    for r in inv.select("grapheme", M.of_features(F.col("features"), s).alias("x")).collect():
        assert r.x == [M.number(B.of_features(c, CATALOG.inventories[name][r.grapheme])) for c in B.columns(s)], r.grapheme


def test_search(spark):
    s = CATALOG.system()
    texts = random_bundles(s, 12, 5) + ["", "Laryngeal=?", "no such=1", None]
    texts += [B.text(s, tuple(B.of_features(c, CATALOG.inventories["distinctive"][g]) for c in B.columns(s))) for g in "pba"]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts + texts[:2])], "i int, bundle string, distance_ string")
    got = {}
    for r in OB.compatible_graphemes(df, "bundle", CATALOG).orderBy("i", "rank").collect():
        got.setdefault(r.i, []).append((pytest.approx(r.distance, abs=1e-12), r.grapheme))
    listed = [(g, tuple(B.of_features(c, f) for c in B.columns(s))) for g, f in CATALOG.inventories["distinctive"].items()]
    for i, t in enumerate(texts + texts[:2]):
        try:
            cells = B.parse(s, t) if t is not None else None
        except (B.BadCell, KeyError):
            cells = None
        want = sorted((round(B.compare(s, cells, x)["distance"], 12), g.encode(), g) for g, x in listed if B.compatible(s, cells, x)) if cells else []
        assert {g for _, g in got.get(i, [])} == {g for *_, g in want}
        assert [d for d, _ in got.get(i, [])] == [d for d, *_ in want]
