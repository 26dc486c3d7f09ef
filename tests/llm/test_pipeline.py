"""Stages of the pipeline against brute force on the smallest tables."""

import corpus_pipeline as cp
import pytest
from test_operators import check_packed, texts


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), [None]
    out[0] = docs
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_sizes(stages):
    n = [s.count() for s in stages[:-1]]
    assert all(s.columns == stages[0].columns for s in stages[1:-1]) and n == sorted(n, reverse=True) and n[-1] > 0.7 * n[0]
    assert n[1] == n[2]  # line dedup keeps all documents


def test_packing_is_whole(stages):
    check_packed(stages[5].collect(), texts(stages[4]))


def test_run(spark, sf, stages):
    assert cp.run(spark, sf).count() == stages[-1].count()
