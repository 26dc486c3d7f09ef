"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import corpus_pipeline as cp
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from phonospark.llm import decontam, embdedup, fim, htmlext, langid, line_dedup, packing, periodic, pii, simhash, substring, suffix, toxicity

LINE = "a line that many documents have in common, of some length"
ITEM = "what is the name of the river that flows through the old town"
ROWS = [(1, None), (2, ""), (3, " \n\t\n"), (4, f"{LINE}\nmore of it"), (4, f"{LINE}\nmore of it"), (None, LINE), (None, LINE), (5, f"12 34 !? a@b.com\n{LINE}"), (6, ("word " + LINE + "\n") * 4000), (7, f"so {ITEM}? you idiot"), (8, "x" * 100_000)]
#: Names that operators use inside.
CLASH = ["d", "h", "a", "b", "n", "lo", "hi", "k1", "k2", "key", "node", "row", "id", "own", "lost", "spans", "strict", "_doc", "_keys", "_d", "n_lines", "n_dropped", "fp", "component", "score", "held_out", "predicted", "f", "toxic", "g", "copy", "ids", "length", "shard", "kept", "label", "class", "text2", "ranges", "part", "runs", "start", "period", "form", "output", "at", "w", "least", "m", "c", "c1"]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in ROWS], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "short"), (None, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(7, 1, 1), (7, 1, 0), (5, 0, 7), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf


def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


OPERATORS = {
    "op1": lambda spark, docs, sf: packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("sequence_id", "offset"),
    "op2": lambda spark, docs, sf: simhash.near_duplicates(docs),
    "op3": lambda spark, docs, sf: pii.digest(pii.find(docs)),
    "op4": lambda spark, docs, sf: line_dedup.dedup_lines(docs).select("doc_id", "text"),
    "op5": lambda spark, docs, sf: langid.identify(docs),
    "op6": lambda spark, docs, sf: decontam.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")),
    "op7": lambda spark, docs, sf: htmlext.extract_pages(docs.withColumnRenamed("doc_id", "page_id").withColumn("url", F.lit("u")).withColumn("html", F.concat(F.lit("<p>"), "text"))),
    "op9": lambda spark, docs, sf: suffix.remove_repeated(docs),
    "op10": lambda spark, docs, sf: toxicity.score(docs, labels(spark, sf)),
    "op11": lambda spark, docs, sf: periodic.collapse_runs(docs),
    "op12": lambda spark, docs, sf: substring.remove_repeated(docs),
    "op13": lambda spark, docs, sf: fim.fill_in_middle(docs),
}
#: Rows that each gives for ROWS; None: not one a row.
EXPECT = {"op6": 2, "op1": None}


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(name, spark, plain, clashing, tables):
    got = rows(OPERATORS[name](spark, plain, tables))
    want = EXPECT.get(name, len(ROWS))
    assert want is None or len(got) == want
    assert rows(OPERATORS[name](spark, clashing, tables)) == got
    assert OPERATORS[name](spark, plain.limit(0), tables).count() == 0


def test_embeddings(spark):
    hot = [(i, [1.0, float(i % 50), 0.5], 1) for i in range(300)]
    odd = [(300, [1e200, 0.0, 0.0], 1), (301, [1e-200, 0.0, 0.0], 1), (None, [1.0, 2.0, 0.5], 1), (None, None, None)]
    df = spark.createDataFrame(hot + odd, "vec_id long, embedding array<double>, label int")
    more = df.select("*", *(F.lit("own").alias(c) for c in ("v", "ok", "class", "check", "n", "root", "own", "blocks", "i", "j", "links", "low", "component")))
    got = rows(embdedup.linked(df))
    assert len(got) == 304 and rows(embdedup.linked(more)) == got == rows(embdedup.linked(df, block=64))
    assert embdedup.linked(df.limit(0)).count() == 0


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stage(name, stage, spark, clashing, tables):
    out = stage(spark, clashing, tables)
    got = out.collect()
    if name == "packing":
        assert {r.doc_id for r in got} == {i for i, _ in ROWS} and sum(r.start == 0 for r in got) == len(ROWS)
    else:
        assert out.columns == clashing.columns and all(r[c] == f"own {c}" for r in got for c in CLASH)
    lost = {"toxicity": {7}, "decontamination": {7}, "line_dedup": set(), "packing": set()}
    if name in lost:
        kept = [r.doc_id for r in got] if name != "packing" else [r.doc_id for r in got if r.start == 0]
        assert sorted(map(str, kept)) == sorted(str(i) for i, _ in ROWS if i not in lost[name])
    else:  # no text, and no words, are one group; so are rows of one text
        assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 4, 5, 6, 7, 8] and sum(r.doc_id is None for r in got) == 1
    assert stage(spark, clashing.limit(0), tables).count() == 0
