"""A header in many rows with differing text around it: no task sorts all contexts of its anchor."""

import random

import pytest
from test_operators import hold_suffix

from phonospark.llm import suffix

HEADER = "".join(chr(97 + i * i % 23) for i in range(150))


def rows():
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(120)  # some rows share more than the header
    out = [(i if i % 7 else None, word(130) + (shared[-rng.randrange(40, 120) :] if i % 3 == 0 else "") + HEADER + (shared[: rng.randrange(30, 90)] if i % 4 == 0 else "") + word(130)) for i in range(90)]
    return out + out[:3]


@pytest.mark.parametrize("most", [20, suffix.MOST])
def test_hot_anchor(spark, monkeypatch, most):
    old = suffix.remove_repeated
    monkeypatch.setattr(suffix, "remove_repeated", lambda df: old(df, most=most))
    hold_suffix(spark.createDataFrame(rows(), "doc_id long, text string"))


def test_hot_contexts_are_not_sorted_together(spark, monkeypatch):
    seen, old = [], suffix.window_verdicts
    monkeypatch.setattr(suffix, "window_verdicts", lambda brought, length: seen.append(brought.groupBy("h").count().agg({"count": "min"}).first()[0]) or old(brought, length))
    suffix.remove_repeated(spark.createDataFrame(rows(), "doc_id long, text string"), most=20).count()
    assert seen and seen[0] > 20


def test_hot_keys_are_dealt(spark):
    from pyspark.sql import functions as F

    from phonospark.llm import common

    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("h"), F.col("id").alias("d"))
    small = spark.createDataFrame([(7, 334), (8, 1), (10, 1), (5000, 1)], "h long, n long")
    want = sorted((r.h, r.d) for r in big.collect() if r.h in (7, 8, 10))
    for limit in (10, 1000):
        assert sorted((r.h, r.d) for r in common.semi_join_hot(big, small, "h", "n", ["d"], limit).collect()) == want
        joined = common.join_hot(big, small, ["h"], "n", "inner", limit)
        assert sorted((r.h, r.d) for r in joined.collect()) == want and all(r.n == (334 if r.h == 7 else 1) for r in joined.collect())
        assert common.join_hot(big, small, ["h"], "n", "left", limit).count() == 1000
