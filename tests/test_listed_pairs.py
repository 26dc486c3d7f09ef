"""c and ç are listed together, a palatal affricate: the pair stays one segment when words are segmented."""

from phonospark.functions.resolver import Resolver
from phonospark.plans import queries as q

#: As tokens are written, with the cedilla apart.
CEDILLA = "c\u0327"
PAIR = "c" + CEDILLA


def test_listed_in_both_systems():
    for system in q.SYSTEMS:
        resolve = Resolver(q.catalog().system(system), q.catalog().inventories[system])
        for spelling in (PAIR, "c\u00e7"):
            got = resolve(spelling)
            assert (got.path, got.grapheme) == ("inventory", PAIR)
            assert set(got.features) >= {"affricate", "consonant", "palatal", "voiceless"}


def test_system_tokens_joins_the_pair(spark, tmp_path):
    spark.createDataFrame([("cça ccça tsc",), ("çca cça",)], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.segment: (r.n, r.types) for r in q.system_tokens(spark, str(tmp_path)).collect()}
    assert got == {PAIR: (3, 2), "a": (4, 3), "c": (3, 3), "ts": (1, 1), CEDILLA: (1, 1)}


def test_turn_segments_joins_the_pair(spark, tmp_path):
    spark.createDataFrame([("user", "Cça c ça"), ("assistant", "aç cça")], "role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.role, r.segment): r.n for r in q.turn_segments(spark, str(tmp_path)).collect()}
    assert got == {("user", PAIR): 1, ("user", "a"): 2, ("user", "c"): 1, ("user", CEDILLA): 1, ("assistant", PAIR): 1, ("assistant", "a"): 2, ("assistant", CEDILLA): 1}
