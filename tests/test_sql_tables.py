"""Table functions in SQL against the column functions."""

from pyspark.sql import functions as F

from phonospark.functions import strings as S
from phonospark.functions.sql import register_tables
from phonospark.operators import resolve
from phonospark.sources.catalog import Catalog

TEXTS = ["t͡ʃatʃka55 kpa", "ma214+ta⁵", "", "ˈna̋³¹²ka n⁵", "5 5a", "ai̯55³", None, "ma⁰ ⁵⁵", "Ünïcode 12"]


def test_rows(spark):
    c = Catalog.builtin()
    names = register_tables(spark, c)
    assert names == ["phono_tokens", "phono_merged_tokens", "phono_segments", "phono_diagnosis", "phono_inventory"]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, s string")
    df.createOrReplaceTempView("texts")

    def rows(name):
        got = {i: [] for i, t in enumerate(TEXTS) if t is not None}
        for r in spark.sql(f"SELECT i, pos, token FROM texts, LATERAL {name}(s) ORDER BY i, pos").collect():
            got[r.i].append(r.token)
        return got

    plain = df.where("s IS NOT NULL").withColumn("t", S.segment_ipa(F.col("s")))
    assert rows("phono_tokens") == {r.i: r.t for r in plain.collect()}
    assert rows("phono_merged_tokens") == {r.i: r.m for r in plain.select("i", S.merge_tone_digits(F.col("t")).alias("m")).collect()}
    assert rows("phono_segments") == {r.i: r.segments for r in resolve.system_segment(plain, "t", c).collect()}
    told = {r.i: (r.status, r.valid_prefix_bytes, r.offending_offset, r.offending) for r in spark.sql("SELECT i, d.* FROM texts, LATERAL phono_diagnosis(s) d").collect()}
    assert told == {r.i: tuple(r.diagnosis) for r in resolve.diagnose(df.where("s IS NOT NULL"), "s", c).collect()}
    assert spark.sql("SELECT count(*) FROM phono_inventory()").first()[0] == 769
