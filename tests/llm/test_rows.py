"""Stages decide row by row: null ids are hit, and repeated ids only where their own text is."""

import corpus_pipeline as cp
from test_operators import EDGE

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "what is the name of the river that flows through the old town"
CLEAN = "a plain sentence on the weather of the week"
BAD = "you are a stupid idiot. you are a worthless moron. you pathetic loser, you scum."


def held(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", None, 1) for i, t in pairs], DOCS)


def tables(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_rows_are_decided_each(spark, tmp_path):
    sf = tables(spark, tmp_path)
    edge = [(i, t) for i, t, *_ in EDGE]
    for stage, bad in ((cp.drop_toxic, BAD), (cp.drop_contaminated, "so " + ITEM + "?")):
        docs = frame(spark, [*edge, (7, CLEAN), (7, bad), (None, bad), (None, CLEAN), (8, bad)])
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert held(out) == sorted([*edge, (7, CLEAN), (None, CLEAN)], key=str)


def test_a_benchmark_that_is_joined(spark, tmp_path):
    from phonospark.llm import decontam

    other = "which of these metals is liquid at the temperature of a room"
    bench = spark.createDataFrame([(1, ITEM), (2, other)], "item_id long, text string")
    docs = frame(spark, [(7, ITEM), (7, CLEAN), (None, other)])
    assert held(decontam.decontaminate(docs, bench, broadcast_bytes=0)) == [(7, CLEAN)]
