"""Inventories compared: composition of a sample, frequency, nearest neighbours, economy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonospark.functions import scoring
from phonospark.functions.geometry import DEFAULT_SYSTEM
from phonospark.operators.resolve import by_grammar, resolve_types, with_types
from phonospark.sources.catalog import Catalog

LOW_COVERAGE = 0.5


def sample_composition(inventories: DataFrame, languages: DataFrame) -> DataFrame:
    """(level, name, n): inventories, distinct languages, and both by family and area, in one pass.

    Inventories whose language isn't listed count under `(unknown)`.
    """
    j = inventories.join(languages, "glottocode", "left").select("inventory", "glottocode", F.coalesce("family", F.lit("(unknown)")).alias("family"), F.coalesce("macroarea", F.lit("(unknown)")).alias("area"))
    whole = j.agg(F.count("*").alias("inventories"), F.count_distinct("glottocode").alias("languages"))
    totals = whole.select(F.explode(F.array(F.struct(F.lit("total").alias("level"), F.lit("inventories").alias("name"), F.col("inventories").alias("n")), F.struct(F.lit("total").alias("level"), F.lit("languages").alias("name"), F.col("languages").alias("n")))).alias("t")).select("t.*")
    by = j.select(F.explode(F.array(F.struct(F.lit("family").alias("level"), F.col("family").alias("name")), F.struct(F.lit("area").alias("level"), F.col("area").alias("name")))).alias("t"))
    return totals.unionByName(by.groupBy("t.level", "t.name").agg(F.count("*").alias("n")))


def segment_frequency(inventories: DataFrame) -> DataFrame:
    """(segment, n, share): inventories that have each segment, and their share of all."""
    total = inventories.agg(F.count("*").alias("total"))
    each = inventories.select(F.explode(F.array_distinct("segments")).alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))
    return each.crossJoin(F.broadcast(total)).select("segment", "n", (F.col("n") / F.col("total")).alias("share"))


def most_common(frequency: DataFrame, n: int) -> DataFrame:
    return frequency.orderBy(F.desc("n"), "segment").limit(n)


def readability(inventories: DataFrame, catalog: Catalog, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """(inventory, readable, unreadable): segments split by whether the system reads them, in order."""
    each = inventories.select("inventory", F.posexplode("segments").alias("pos", "token"))
    types = resolve_types(each, catalog, system).select("token", (F.col("status") == "ok").alias("ok"))
    parts = each.join(types, "token").groupBy("inventory").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "ok"))).alias("x"))
    pick = lambda good: F.transform(F.filter("x", lambda e: e["ok"] == good), lambda e: e["token"])
    return parts.select("inventory", pick(True).alias("readable"), pick(False).alias("unreadable"))


def distances(tokens: DataFrame, catalog: Catalog, system: str = DEFAULT_SYSTEM, preset: str | None = None) -> DataFrame:
    """(a, b, score, coverage, comparability) of all ordered pairs of the distinct readable tokens.

    Types are few (thousands): the pairs are what is asked for, scored once and then joined.
    """
    s = catalog.system(system)
    types = resolve_types(tokens, catalog, system).where(F.col("status") == "ok").select("token", scoring.prepare(F.col("r"), s).alias("p"))
    d = scoring.segment_distance(F.col("x.p"), F.col("y.p"), s, preset)
    # both sides read one exchange, of a number of partitions that isn't cut down to the few bytes that types have
    types = types.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token")
    # either order scores the same: each pair is scored once and told twice
    half = types.alias("x").join(types.alias("y"), F.col("x.token") <= F.col("y.token"))
    scored = half.select(F.col("x.token").alias("a"), F.col("y.token").alias("b"), d.alias("d"))
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return scored.select(F.explode(ways).alias("w"), "d").select("w.*", "d.*")


def pair_distances(pairs: DataFrame, catalog: Catalog, system: str = DEFAULT_SYSTEM, preset: str | None = None) -> DataFrame:
    """pairs (a, b, ...) with score, coverage, comparability; null where one isn't read. Only these pairs are scored."""
    s = catalog.system(system)
    tokens = pairs.select(F.explode(F.array("a", "b")).alias("token"))
    types = resolve_types(tokens, catalog, system).where(F.col("status") == "ok").select(F.col("token").alias("_token"), scoring.prepare(F.col("r"), s).alias("p"))
    # both joins read one exchange of encoded types
    types = types.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_token")
    both = with_types(with_types(pairs, "a", types.withColumnRenamed("p", "_x")), "b", types.withColumnRenamed("p", "_y"))
    d = F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), scoring.segment_distance(F.col("_x"), F.col("_y"), s, preset))
    return both.withColumn("_d", d).select(*(F.col(f"`{c}`") for c in pairs.columns), "_d.*")


def system_pair_distances(pairs: DataFrame, catalog: Catalog, systems: list[str] | None = None, preset: str | None = None) -> DataFrame:
    """The same for pairs (system, a, b, ...) of several systems (all by default): tokens are resolved in all of them at once."""
    names = systems or catalog.names()
    tokens = pairs.select(F.explode(F.array("a", "b")).alias("token"))
    types = by_grammar(tokens.where(F.col("token").isNotNull()).distinct(), catalog, *names).where(F.col("status") == "ok")
    encoded = reduce(lambda c, n: c.when(F.col("system") == n, scoring.prepare(F.col("r"), catalog.system(n))), names, F)
    types = types.select("system", "token", encoded.alias("p")).repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token")
    both = pairs
    for c, p in (("a", "_x"), ("b", "_y")):
        both = both.join(types.select(F.col("token").alias(c), "system", F.col("p").alias(p)), ["system", c], "left")
    read = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    d = reduce(lambda c, n: c.when(read & (F.col("system") == n), scoring.segment_distance(F.col("_x"), F.col("_y"), catalog.system(n), preset)), names, F)
    return both.withColumn("_d", d).select(*(F.col(f"`{c}`") for c in pairs.columns), "_d.*")


def compatibility_dissimilarity(tokens: DataFrame, catalog: Catalog, system: str = DEFAULT_SYSTEM, preset: str | None = None) -> DataFrame:
    """Another name of `distances`: score, coverage and comparability of all pairs."""
    return distances(tokens, catalog, system, preset)


def inventory_comparison(pairs: DataFrame, inventories: DataFrame, catalog: Catalog, system: str = DEFAULT_SYSTEM, preset: str | None = None) -> DataFrame:
    """(a, b, score, mean_coverage, comparability, low_coverage) for pairs (a, b) of inventories.

    The mean of both directions' mean distance to the nearest segment. A nearest segment scores below
    1.0; of equal scores the first stands. Segments without one count 1.0 and no coverage; inventories
    without readable segments have no score.
    """
    each = inventories.select("inventory", F.posexplode("segments").alias("pos", "token"))
    ways = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    readable = resolve_types(each, catalog, system).where(F.col("status") == "ok").select("token")
    own = each.join(readable, "token", "left_semi")
    kinds = own.select("inventory", "token").distinct()
    # distinct segments that meet in a pair of inventories, each once
    meet = pairs.select("a", "b").distinct().join(kinds.select(F.col("inventory").alias("a"), F.col("token").alias("s")), "a").join(kinds.select(F.col("inventory").alias("b"), F.col("token").alias("t")), "b")
    meet = meet.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()
    half = pair_distances(meet, catalog, system, preset).select("a", "b", "score", "coverage")
    table = half.union(half.where("a <> b").select("b", "a", "score", "coverage"))
    source = ways.join(own.select(F.col("inventory").alias("a"), F.col("pos").alias("p"), F.col("token").alias("s")), "a")
    both = source.join(own.select(F.col("inventory").alias("b"), F.col("pos").alias("q"), F.col("token").alias("t")), "b")
    scored = both.join(table.withColumnsRenamed({"a": "s", "b": "t"}), ["s", "t"])
    near = scored.groupBy("a", "b", "p").agg(F.min(F.when(F.col("score") < 1, F.struct("score", "q", "coverage"))).alias("m"))
    way = near.groupBy("a", "b").agg(F.avg(F.coalesce("m.score", F.lit(1.0))).alias("score"), F.avg(F.coalesce("m.coverage", F.lit(0.0))).alias("coverage"))
    back = way.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("score").alias("score2"), F.col("coverage").alias("coverage2"))
    got = pairs.select("a", "b").join(way, ["a", "b"], "left").join(back, ["a", "b"], "left")
    covered = (F.col("coverage") + F.col("coverage2")) / 2
    return got.select("a", "b", ((F.col("score") + F.col("score2")) / 2).alias("score"), F.coalesce(covered, F.lit(0.0)).alias("mean_coverage"), F.when(F.col("score").isNull() | F.col("score2").isNull(), "no-score").otherwise("ok").alias("comparability"), F.coalesce(covered < LOW_COVERAGE, F.lit(True)).alias("low_coverage"))


def feature_economy(inventories: DataFrame, catalog: Catalog, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """(inventory, n_segments, n_features, economy): readable segments over columns that any of them uses."""
    s = catalog.system(system)
    each = inventories.select("inventory", F.explode(F.array_distinct("segments")).alias("token"))
    types = resolve_types(each, catalog, system).where(F.col("status") == "ok").select("token", scoring.vector(F.col("r.features"), s).alias("v"))
    used = types.select("token", F.transform("v", lambda x: ((x != 0) & ~F.isnan(x)).cast("int")).alias("u"))
    flat = each.join(used, "token").select("inventory", "token", F.posexplode("u").alias("k", "on"))
    by_column = flat.groupBy("inventory", "k").agg(F.max("on").alias("on"), F.count("*").alias("n"))
    out = by_column.groupBy("inventory").agg(F.max("n").alias("n_segments"), F.sum("on").alias("n_features"))
    return out.select("inventory", "n_segments", "n_features", F.when(F.col("n_features") > 0, F.col("n_segments") / F.col("n_features")).otherwise(0.0).alias("economy"))


def distance_matrix(tokens: DataFrame, catalog: Catalog, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """(a, row map<b, score>): all pairs as rows; a pair that can't be scored isn't in the map."""
    d = distances(tokens, catalog, system)
    return d.groupBy("a").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "score")))).alias("row"))


def nearest(table: DataFrame, n: int = 1) -> DataFrame:
    """The n nearest others of each token, ties by name."""
    w = Window.partitionBy("a").orderBy("score", "b")
    return table.where("a <> b").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
