"""Batched alignment, resampling and cross-validation against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from phonospark.operators import alignment as A
from phonospark.operators import corpus


def plain(x, y, cost, gap):
    """Columns of the cheapest alignment; of equal ways diagonal, then up, then left."""
    n, m = len(x), len(y)
    best = {(0, 0): 0.0}
    for i in range(n + 1):
        for j in range(m + 1):
            ways = []
            if i and j:
                ways.append(best[i - 1, j - 1] + cost(x[i - 1], y[j - 1]))
            if i:
                ways.append(best[i - 1, j] + gap)
            if j:
                ways.append(best[i, j - 1] + gap)
            if ways:
                best[i, j] = min(ways)
    out, (i, j) = [], (n, m)
    while i or j:
        if i and j and abs(best[i, j] - best[i - 1, j - 1] - cost(x[i - 1], y[j - 1])) < 1e-12:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and abs(best[i, j] - best[i - 1, j] - gap) < 1e-12:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def random_pairs(seed, n, letters="abcdx", most=9):
    rng = random.Random(seed)
    word = lambda: [rng.choice(letters) for _ in range(rng.randrange(most))]
    return [(k, word(), word()) for k in range(n)] + [(n, [], []), (n + 1, ["a"] * 40, ["b"] * 3), (n + 2, None, ["a"])]


COSTS = [(a, b, random.Random(a + b).choice([0.2, 0.4, 0.5, 0.8, 1.0])) for a in "abcd" for b in "abcd" if a != b]


@pytest.mark.parametrize("cells, most", [(1 << 22, 500_000), (2000, 500_000), (1 << 22, 3)])
def test_all_gaps_equal_the_plain_version(spark, monkeypatch, cells, most):
    monkeypatch.setattr(A, "CELLS", cells)
    monkeypatch.setattr(A, "BROADCAST_COSTS", most)
    rows = random_pairs(1, 300)
    table = {(a, b): s for a, b, s in COSTS}
    cost = lambda a, b: 0.0 if a == b else table.get((a, b), 1.0)
    pairs = spark.createDataFrame(rows, "k long, s1 array<string>, s2 array<string>")
    costs = spark.createDataFrame(COSTS, "a string, b string, score double")
    got = {r.k: r for r in A.align_gaps(pairs, costs).collect()}
    assert len(got) == len(rows)
    for k, x, y in rows:
        told = [(z.gap, [tuple(c) for c in z.columns]) for z in got[k].alignments]
        assert told == [(g, plain(x or [], y or [], cost, g)) for g in A.GAPS]
    one = {r.k: [tuple(c) for c in r.columns] for r in A.align(pairs, costs, 0.4).collect()}
    assert one == {k: plain(x or [], y or [], cost, 0.4) for k, x, y in rows}
    assert A.align(pairs.limit(0), costs, 0.4).count() == 0


@pytest.mark.parametrize("most", [500_000, 3])
def test_costs_by_a_column(spark, monkeypatch, most):
    monkeypatch.setattr(A, "BROADCAST_COSTS", most)
    rows = [(k, k % 2, x, y) for k, x, y in random_pairs(2, 80)[:80]]
    costs = [(0, a, b, s) for a, b, s in COSTS] + [(1, a, b, 1.2 - s) for a, b, s in COSTS]
    tables = [{(a, b): s for o, a, b, s in costs if o == of} for of in (0, 1)]
    pairs = spark.createDataFrame(rows, "k long, of int, s1 array<string>, s2 array<string>").withColumn("of", F.col("of").cast("string"))
    got = A.align_gaps(pairs, spark.createDataFrame(costs, "of int, a string, b string, score double").withColumn("of", F.col("of").cast("string")), (0.3, 0.5), by="of").collect()
    for r in got:
        cost = lambda a, b: 0.0 if a == b else tables[int(r.of)].get((a, b), 1.0)  # noqa: B023, E731
        assert [[tuple(c) for c in z.columns] for z in r.alignments] == [plain(r.s1, r.s2, cost, g) for g in (0.3, 0.5)]


def test_gap_accuracy(spark):
    rng = random.Random(3)
    rows = [(k, x, y, [(i, i) for i in range(min(len(x), len(y)))] + [(i, -1) for i in range(len(y), len(x))] + [(-1, j) for j in range(len(x), len(y))]) for k, x, y in random_pairs(4, 150)[:150]]
    pairs = spark.createDataFrame(rows, f"k long, s1 array<string>, s2 array<string>, gold {A.COLUMNS}")
    costs = spark.createDataFrame(COSTS, "a string, b string, score double")
    table = {(a, b): s for a, b, s in COSTS}
    cost = lambda a, b: 0.0 if a == b else table.get((a, b), 1.0)
    want = {}
    for g in A.GAPS:
        told = [(plain(x, y, cost, g), gold) for _, x, y, gold in rows]
        want[g] = (sum(len(set(c) & set(gold)) for c, gold in told) / sum(len(gold) for _, gold in told), sum(set(c) == set(gold) for c, gold in told) / len(rows))
    got = {r.gap: (r.column_accuracy, r.perfect) for r in A.gap_accuracy(pairs, costs).collect()}
    assert {g: pytest.approx(v) for g, v in want.items()} == got
    assert A.tune_gap(pairs, costs) == max(A.GAPS, key=lambda g: (want[g][0], -g)) and rng


def weight(key, r, seed):
    low = (1 << 32) - 1
    mix = lambda c: ((c & low) ^ ((c & low) >> 16)) * 0x2C1B3C6D & low
    k = key & (1 << 64) - 1
    x = mix(k ^ (k >> 32))
    x = mix(mix(x + r * 0x297A2D39 + seed * 0x1B56C4E9))
    x ^= x >> 16
    return sum(x >= int(p * (1 << 32)) for p in A.DRAWS)


def test_bootstrap_interval(spark):
    rng = random.Random(5)
    rows = [(k * 7919 - 1000, rng.gauss(1, 1), rng.gauss(0.5, 1)) for k in range(300)]
    df = spark.createDataFrame([*rows, (5_000_000, None, 1.0)], "k long, v double, o double")
    got = A.bootstrap_interval(df, "v", "k", "o", resamples=100).first()
    means = []
    for r in range(100):
        w = [weight(k, r, 7) for k, _, _ in rows]
        means.append(sum(x * (v - o) for x, (_, v, o) in zip(w, rows)) / sum(w))
    means.sort()
    assert (got.n, got.mean) == (300, pytest.approx(sum(v - o for _, v, o in rows) / 300))
    assert (got.low, got.high) == (pytest.approx(means[2]), pytest.approx(means[97]))
    # as wide as by the driver's resampling
    _, low, high = A.bootstrap([v for _, v, _ in rows], [o for _, _, o in rows])
    full = A.bootstrap_interval(df, "v", "k", "o").first()
    assert full.high - full.low == pytest.approx(high - low, rel=0.25)


def test_draws_are_poisson(spark):
    ids = spark.range(200_000).selectExpr("id", "3 AS three", "4 AS four")
    t = A.draws(A.draws(ids, "id", "three").withColumnRenamed("w", "a"), "id", "four").withColumnRenamed("w", "b")
    r = t.select(F.avg("a"), F.var_pop("a"), F.corr("a", "b"), F.avg((F.col("a") == 0).cast("double"))).first()
    assert [*r] == [pytest.approx(1, abs=0.01), pytest.approx(1, abs=0.02), pytest.approx(0, abs=0.01), pytest.approx(0.3679, abs=0.005)]


def test_no_rows(spark):
    r = A.bootstrap_interval(spark.createDataFrame([], "k long, v double"), "v", "k").first()
    assert tuple(r) == (None, None, None, None)


def plain_leave_one_out(pairs, base, group):
    """Each group fitted, tuned and tested by itself."""
    out = {}
    aligned = F.filter("gold", lambda c: (c["a"] >= 0) & (c["b"] >= 0))
    together = pairs.select(group, F.explode(F.transform(aligned, lambda c: F.struct(F.get("s1", c["a"]).alias("x"), F.get("s2", c["b"]).alias("y")))).alias("t")).select(group, "t.*")
    for held in sorted(r[group] for r in pairs.select(group).distinct().collect()):
        train, test = pairs.where(F.col(group) != held), pairs.where(F.col(group) == held)
        fitted = corpus.shrunk_costs(corpus.pair_costs(together.where(F.col(group) != held)), base)
        row = []
        for costs in (base, fitted):
            gap = A.tune_gap(train, costs)
            told = A.align(test, costs, gap)
            row += [gap, A.evaluate(told).first()["column_accuracy"], corpus.calibration_gap(corpus.calibration(corpus.predicted_pairs(told, costs))).first()["gap"]]
        out[held] = row
    return out


def test_leave_one_out_is_each_group_by_itself(spark):
    rng = random.Random(6)
    rows = []
    for family, swap in (("A", "td"), ("B", "td"), ("C", "sz")):
        for _ in range(25):
            x = [rng.choice("taosz") for _ in range(rng.randrange(2, 5))]
            y = [swap[1] if c == swap[0] and rng.random() < 0.8 else c for c in x]
            if rng.random() < 0.3:
                y = y[1:]
            off = len(x) - len(y)
            rows.append((family, x, y, [(i, -1) for i in range(off)] + [(i + off, i) for i in range(len(y))]))
    pairs = spark.createDataFrame(rows, f"family string, s1 array<string>, s2 array<string>, gold {A.COLUMNS}")
    base = spark.createDataFrame([(a, b, 0.0 if a == b else 0.3 if {a, b} <= set("ao") else 0.6) for a in "tdaosz" for b in "tdaosz"], "a string, b string, score double")
    want = plain_leave_one_out(pairs, base, "family")
    got = {r.held: [r.gap_base, r.accuracy_base, r.calibration_base, r.gap_fitted, r.accuracy_fitted, r.calibration_fitted] for r in corpus.leave_one_out(pairs, base).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
