from pyspark.sql import functions as F

from phonospark.operators.resolve import by_grammar
from phonospark.sources.catalog import Catalog
from phonospark.streaming import tokens


def test_stream_equals_batch(spark, tmp_path):
    words = [("t͡ʃa55",), ("kpa",), ("x?",)]
    spark.createDataFrame(words, "s string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string").parquet(str(tmp_path / "in"))
    q = tokens.resolved_stream(stream, "s", Catalog.builtin()).select("token", "status").writeStream.format("memory").queryName("resolved").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("resolved").collect())
    from phonospark.functions import strings as S

    batch = by_grammar(spark.createDataFrame(words, "s string").select(F.explode(S.segment_ipa(F.col("s"))).alias("token")), Catalog.builtin())
    assert got == sorted(tuple(r) for r in batch.select("token", "status").collect())


def test_windows(spark, sf):
    t = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type")
    assert tokens.windowed_counts(t, "event_type", "ts").agg(F.sum("n")).first()[0] == t.agg(F.sum(F.length(F.regexp_replace("event_type", " ", "")))).first()[0]
