"""Queries over whole tables, and the SQL that each is held against.

The tables hold no transcriptions, so their letters stand in for segments, and published example values
(`known`) for what letters can't show. The SQL side encodes the 26 letters from their published labels, as
VALUES, and scores pairs in long form, one row a dimension.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonospark.functions import scoring, sql, tables
from phonospark.functions import strings as S
from phonospark.operators import alignment, bundles, corpus, resolve, typology
from phonospark.plans import known
from phonospark.sources import sinks
from phonospark.sources.catalog import Catalog

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SYSTEMS = ["descriptive", "distinctive"]


@cache
def catalog() -> Catalog:
    return Catalog.builtin()


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in LETTERS], "token string")


def _chars(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]"), F.lit(0))


# --- the SQL side: encoded letters, and distances in long form


def _encoded(system: str) -> tuple[str, str]:
    """VALUES of (letter, k, v) and of (k, kind, w, d)."""
    s, rows = catalog().system(system), _labels()
    plan = scoring.plan(s)
    values = []
    for x in LETTERS:
        f = set(rows[x])
        v: list = [1.0 if f & set(d.positive) else -1.0 if f & set(d.negative) else None for d in s.binary]
        v += [c.level(f) for c in s.ordinal]
        v += [sum(1 << i for i, y in enumerate(g) if y in f) or None for _, g in s.grouped]
        values += [f"('{x}', {k}, {y})" for k, y in enumerate(v) if y is not None]
    return ", ".join(values), ", ".join(f"({k}, {kind}, {w!r}, {d!r})" for k, (kind, w, d) in enumerate(plan))


@cache
def _labels() -> dict[str, tuple[str, ...]]:
    """Published labels of the letters; c, which isn't among the published examples, is stated here."""
    out = {g: tuple(f.split("|")) for g, f in known.rows(known.FEATURES, 2)}
    out["c"] = ("consonant", "consonantal", "dorsal", "non-continuant", "obstruent", "palatal", "stop", "voiceless")
    return out


@cache
def _distance_ctes(system: str, name: str = "dist") -> str:
    """`dist(a, b, score, coverage)` over all ordered pairs of letters."""
    values, plan = _encoded(system)
    return f"""
        {name}_e(x, k, v) AS (VALUES {values}),
        {name}_p(k, kind, w, d) AS (VALUES {plan}),
        {name}_l AS (SELECT DISTINCT x FROM {name}_e),
        {name}_t AS (
            SELECT a.x AS a, b.x AS b, p.kind, p.w, p.d, ea.v::DOUBLE AS p, eb.v::DOUBLE AS q
            FROM {name}_l a CROSS JOIN {name}_l b CROSS JOIN {name}_p p
            LEFT JOIN {name}_e ea ON ea.x = a.x AND ea.k = p.k LEFT JOIN {name}_e eb ON eb.x = b.x AND eb.k = p.k),
        {name}_u AS (
            SELECT a, b, w, CASE WHEN kind = 2 THEN (p IS DISTINCT FROM q)::INT::DOUBLE ELSE abs(coalesce(p, 0) - coalesce(q, 0)) / d END AS delta
            FROM {name}_t WHERE CASE WHEN kind = 1 THEN p IS NOT NULL AND q IS NOT NULL ELSE p IS NOT NULL OR q IS NOT NULL END),
        {name} AS (SELECT a, b, sum(w * delta) / sum(w) AS score FROM {name}_u GROUP BY a, b)"""


# --- queries


def letter_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, letter, n): letters of all documents by language, counted without a row for each letter."""
    t = F.lower("text")
    counts = [F.sum(F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))).alias(x) for x in LETTERS]
    wide = _read(spark, sf_dir, "documents").groupBy("lang").agg(*counts)
    long = wide.select("lang", F.explode(F.array(*(F.struct(F.lit(x).alias("letter"), F.col(x).alias("n")) for x in LETTERS))).alias("t"))
    return long.select("lang", "t.letter", "t.n").where("n > 0")


def letter_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language the three pairs of letters of largest distance times the rarer one's count."""
    freq = letter_frequency(spark, sf_dir)
    d = typology.distances(_letters(spark), catalog()).select("a", "b", "score").where("a < b")
    x, y = freq.select("lang", F.col("letter").alias("a"), F.col("n").alias("na")), freq.select("lang", F.col("letter").alias("b"), F.col("n").alias("nb"))
    pairs = x.join(y, "lang").where("a < b").join(F.broadcast(d), ["a", "b"])
    weighed = pairs.withColumn("weight", F.round(F.col("score") * F.least("na", "nb"), 6))
    w = Window.partitionBy("lang").orderBy(F.desc("weight"), "a", "b")
    return weighed.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("lang", "a", "b", F.round("score", 9).alias("score"), "weight", "rank")


def segment_distance(system: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = typology.distances(_letters(spark), catalog(), system)
        return d.select("a", "b", F.round("score", 9).alias("score"))

    return query


def nearest_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = typology.distances(_letters(spark), catalog()).select("a", "b", F.round("score", 9).alias("score"))
    return typology.nearest(d, 2).select("a", "b", "score", F.col("rank").cast("long").alias("rank"))


def _inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("inventory"), "n_regionkey", _chars(F.col("n_name")).alias("segments"))


def sample_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as inventories of their nations, in regions; nations of the last region aren't listed."""
    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    languages = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).where("r_regionkey < 4").select(F.col("n_nationkey").alias("glottocode"), F.left("n_name", F.lit(1)).alias("family"), F.col("r_name").alias("macroarea"))
    inv = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("inventory"), F.col("s_nationkey").alias("glottocode"))
    return typology.sample_composition(inv, F.broadcast(languages))


def segment_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typology.segment_frequency(_inventories(spark, sf_dir)).select("segment", "n", F.round("share", 9).alias("share"))


def most_common_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typology.most_common(segment_frequency(spark, sf_dir), 10)


def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of brands, digits included, split by whether the system reads them."""
    brands = _read(spark, sf_dir, "part").select("p_brand").distinct()
    inv = brands.select(F.col("p_brand").alias("inventory"), F.split(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), "").alias("segments"))
    out = typology.readability(inv, catalog())
    return out.select("inventory", F.array_join("readable", "").alias("readable"), F.array_join("unreadable", "").alias("unreadable"))


def inventory_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of one region, compared by the letters of their names."""
    inv = _inventories(spark, sf_dir)
    pairs = inv.alias("x").join(inv.alias("y"), (F.col("x.n_regionkey") == F.col("y.n_regionkey")) & (F.col("x.inventory") < F.col("y.inventory"))).select(F.col("x.inventory").alias("a"), F.col("y.inventory").alias("b"))
    out = typology.inventory_comparison(pairs, inv, catalog())
    return out.select("a", "b", F.round("score", 9).alias("score"), F.round("mean_coverage", 9).alias("mean_coverage"), "comparability", "low_coverage")


def feature_economy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = typology.feature_economy(_inventories(spark, sf_dir), catalog())
    return out.select("inventory", "n_segments", F.col("n_features").cast("long").alias("n_features"), F.round("economy", 9).alias("economy"))


def _part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "part").select(F.col("p_type").alias("dataset"), F.explode(F.split(F.lower(F.regexp_replace(F.concat("p_name", "p_brand"), "[^A-Za-z0-9]", "")), "")).alias("token"))
    return t.groupBy("dataset", "token").agg(F.count("*").alias("n"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.coverage(_part_tokens(spark, sf_dir), catalog(), SYSTEMS)


def blocked_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.blocked(_part_tokens(spark, sf_dir), catalog()).withColumn("share", F.round("share", 9))


def form_parse_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names as forms; forms with digits aren't read."""
    t = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), F.posexplode(F.split(F.lower(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))), " ")).alias("at", "word"), "p_partkey")
    forms = t.where("word <> ''").select("dataset", F.concat_ws("-", "p_partkey", "at").alias("form"), F.split("word", "").alias("segments"))
    return corpus.form_parse_rate(forms, catalog()).withColumn("rate", F.round("rate", 9))


def contrast_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that occur in names and types of parts."""
    names = _read(spark, sf_dir, "part").select(F.explode(_chars(F.concat_ws(" ", "p_name", "p_type"))).alias("token"))
    return corpus.contrast_audit(names, catalog(), SYSTEMS)


def orderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters in the two systems that have an inventory here, so both votes are asked for."""
    return corpus.orderings(_letters(spark), catalog(), SYSTEMS, least=2).select("a", "b", "c", "votes", F.col("nearer").cast("long").alias("nearer"))


def pair_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initials of customers' segments against those of their orders' priorities, as aligned pairs."""
    o = _read(spark, sf_dir, "orders").select("o_custkey", F.lower(F.substring("o_orderpriority", 3, 1)).alias("y"))
    c = _read(spark, sf_dir, "customer").select("c_custkey", F.lower(F.left("c_mktsegment", F.lit(1))).alias("x"))
    pairs = o.join(c, o.o_custkey == c.c_custkey).select("x", "y").where("y <> ''")
    return corpus.pair_costs(pairs).select("a", "b", "n", F.round("cost", 9).alias("cost"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts as scores against returned lines."""
    t = _read(spark, sf_dir, "lineitem").select(F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("matched"))
    out = corpus.calibration(t)
    return out.select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("rate", 9).alias("rate"))


def cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price by priority as folds."""
    folds = _read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("value"))
    return corpus.cross_validated(folds).select("n", "improved", *(F.round(c, 4).alias(c) for c in ("mean", "low", "high")))


def tokens_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orthographic tokens of part brands and names, by number of uses."""
    t = _read(spark, sf_dir, "part").select(F.explode(S.segment_ascii(F.concat_ws(" ", "p_name", "p_brand"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


def segment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many uses of each character of event types and properties resolve, by status."""
    t = _read(spark, sf_dir, "events").select(F.explode(F.split(F.concat_ws("", "event_type", "props"), "")).alias("token"))
    counts = t.where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    return resolve.resolve(counts, "token", catalog()).groupBy("status").agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))


def feature_vectors(system: str) -> Callable[[SparkSession, str], DataFrame]:
    """(token, k, value): the letters' vectors in long form, zero columns left out."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        types = resolve.resolve_types(_letters(spark), catalog(), system)
        v = types.select("token", F.posexplode(scoring.vector(F.col("r.features"), catalog().system(system))).alias("k", "value"))
        return v.where("value <> 0").select("token", F.col("k").cast("long").alias("k"), F.round("value", 9).alias("value"))

    return query


def _words(text: Column) -> Column:
    """A text's words in lower case, whatever their letters: what lies between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def system_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, n, types): segments of all words of documents, letters that are listed together joined.

    Words repeat: they are counted first, and only distinct ones are segmented.
    """
    words = _read(spark, sf_dir, "documents").select(F.explode(_words(F.col("text"))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    each = resolve.system_segment_text(resolve.spread(counts), "word", catalog()).select("n", F.explode("segments").alias("segment"))
    return each.groupBy("segment").agg(F.sum("n").alias("n"), F.count("*").alias("types"))


def word_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, word, n, status, prefix, offending): how far the words of parts and conversations read as one segment."""
    parts = _read(spark, sf_dir, "part").select(F.lit("part").alias("source"), F.explode(_words(F.col("p_name"))).alias("word"))
    turns = _read(spark, sf_dir, "conversations").select(F.lit("conversations").alias("source"), F.explode(_words(F.col("text"))).alias("word"))
    counts = parts.unionByName(turns).groupBy("source", "word").agg(F.count("*").alias("n"))
    d = resolve.diagnose(counts, "word", catalog()).select("source", "word", "n", "diagnosis.*")
    prefix = F.char_length(F.decode(F.substring(F.encode("word", "UTF-8"), F.lit(1), F.col("valid_prefix_bytes")), "UTF-8"))
    return d.select("source", "word", "n", "status", prefix.alias("prefix"), "offending")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, n, s1, s2, gold): neighbouring words of conversations as sequences, with places of equal number as gold."""
    words = _read(spark, sf_dir, "conversations").select(_words(F.col("text")).alias("w")).where("size(w) > 1")
    two = words.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("x"), F.slice("w", F.lit(2), F.size("w") - 1).alias("y"))).alias("t"))
    counts = two.groupBy("t.x", "t.y").agg(F.count("*").alias("n"))
    pairs = counts.withColumn("s1", S.segment_ipa(F.col("x"))).withColumn("s2", S.segment_ipa(F.col("y")))
    place = lambda i: F.struct(F.when(i < F.size("s1"), i).otherwise(-1).alias("a"), F.when(i < F.size("s2"), i).otherwise(-1).alias("b"))
    return pairs.withColumn("gold", F.transform(F.sequence(F.lit(0), F.greatest(F.size("s1"), F.size("s2")) - 1), place).cast(alignment.COLUMNS))


def _letter_costs(spark: SparkSession) -> DataFrame:
    return typology.distances(_letters(spark), catalog()).select("a", "b", "score")


def word_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, n, gap, columns): neighbouring words of conversations, aligned at all gaps; other signs than letters cost 1."""
    told = alignment.each_gap(alignment.align_gaps(_neighbours(spark, sf_dir).drop("gold"), _letter_costs(spark)))
    return told.select("x", "y", "n", "gap", F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["a"], c["b"])), " ").alias("columns"))


def gap_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words, held at every gap against the pairing of places of equal number."""
    out = alignment.gap_accuracy(_neighbours(spark, sf_dir), _letter_costs(spark))
    return out.select("gap", "pairs", F.round("column_accuracy", 9).alias("column_accuracy"), F.round("perfect", 9).alias("perfect"))


def paired_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of the mean difference of discount and tax over all lines."""
    t = _read(spark, sf_dir, "lineitem").withColumn("key", F.col("l_orderkey") * 16 + F.col("l_linenumber"))
    return alignment.bootstrap_interval(t, "l_discount", "key", "l_tax", resamples=100).select("n", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(role, segment, n): segments of all words of all turns, in SQL alone."""
    sql.register_tables(spark, catalog())
    turns = _read(spark, sf_dir, "conversations")
    return spark.sql(
        """
        WITH w AS (SELECT role, word, count(*) AS n FROM {turns}, LATERAL explode(split(lower(text), '[ ]')) x(word) GROUP BY role, word)
        SELECT role, s.token AS segment, sum(n) AS n FROM w, LATERAL phono_segments(w.word) s GROUP BY role, s.token""",
        turns=turns,
    )


def unread_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(status, offending, n): why words of turns aren't one segment, and at which character, in SQL alone."""
    sql.register_tables(spark, catalog())
    return spark.sql(
        """
        WITH w AS (SELECT word, count(*) AS n FROM {turns}, LATERAL explode(split(lower(text), '\\\\s+')) x(word) WHERE word <> '' GROUP BY word)
        SELECT d.status, d.offending, sum(n) AS n FROM w, LATERAL phono_diagnosis(w.word) d GROUP BY d.status, d.offending""",
        turns=_read(spark, sf_dir, "conversations"),
    )


def toned_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, base, tone, n): a syllable with a two-level tone from each part's size, cut, merged and split again."""
    size = F.col("p_size")
    text = F.concat(F.lit("ma"), F.floor(size % 25 / 5) + 1, size % 5 + 1, F.lit("n"))
    tokens = _read(spark, sf_dir, "part").select(F.explode(S.merge_tone_digits(S.segment_ascii(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return tokens.select("token", S.split_tone(F.col("token")).alias("x"), "n").select("token", "x.base", "x.tone", "n")


def _frame(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """A block of fixed values as a table; all columns are strings until they are cast."""
    names = [c.split()[0] for c in schema.split(",")]
    t = spark.createDataFrame([tuple(r) for r in known.rows(text, len(names))], ", ".join(f"{n} string" for n in names))
    return t.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(",")))


def published_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the published examples, scored; the SQL states the published distances."""
    t = _frame(spark, known.DISTANCES, "system string,a string,b string,d double").select("system", "a", "b")
    # the published values have ten places
    return typology.system_pair_distances(t, catalog(), SYSTEMS).select("system", "a", "b", F.round("score", 8).alias("score"))


def valued_catalog() -> Catalog:
    """The five valued systems with the published examples as inventories."""
    out, rows = catalog(), {}
    for system, g, cells in known.rows(known.VALUED_FEATURES, 3):
        rows.setdefault(system, {})[g] = tuple(cells.split("|"))
    for system, own in rows.items():
        out = out.with_inventory(system, own)
    return out


def valued_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _frame(spark, known.VALUED_DISTANCES, "system string,a string,b string,d double").select("system", "a", "b")
    return typology.system_pair_distances(t, valued_catalog(), valued_catalog().names()[2:]).select("system", "a", "b", F.round("score", 9).alias("score"))


def published_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphemes of the published examples, listed ones and such as the grammar makes, with their labels in both systems."""
    types = resolve.resolve_types(_frame(spark, known.FEATURES, "token string,labels string"), catalog(), *SYSTEMS)
    return types.select("system", F.col("token").alias("grapheme"), "status", F.array_join(F.array_sort("r.features"), "|").alias("labels"))


def _label_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, uses): letters of documents by the labels that the system gives them."""
    counts = letter_frequency(spark, sf_dir).groupBy(F.col("letter").alias("token")).agg(F.sum("n").alias("n"))
    read = resolve.resolve(counts, "token", catalog())
    return read.select(F.explode("r.features").alias("label"), "n").groupBy("label").agg(F.sum("n").alias("uses"))


def _sets(spark: SparkSession, name: str) -> DataFrame:
    return _frame(spark, known.SETS, "name string,labels string").select(F.col("name").alias(name), F.split("labels", r"\|").alias(f"{name}_labels"))


def _set_uses(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """df with uses_a and uses_b: how often letters of documents have the labels of the sets a and b, summed over labels."""
    sets = _sets(spark, "a").select(F.col("a").alias("name"), F.explode("a_labels").alias("label"))
    uses = sets.join(_label_uses(spark, sf_dir), "label").groupBy("name").agg(F.sum("uses").alias("uses"))
    for c in ("a", "b"):
        df = df.join(uses.toDF(c, f"uses_{c}"), c, "left").withColumn(f"uses_{c}", F.coalesce(f"uses_{c}", F.lit(0)))
    return df


def set_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sets of labels by the leaf scorer."""
    t = _frame(spark, known.SET_DISTANCES, "a string,b string,d double").select("a", "b").join(_sets(spark, "a"), "a").join(_sets(spark, "b"), "b")
    d = scoring.sound_distance(F.col("a_labels"), F.col("b_labels"), catalog().system("descriptive"))
    return _set_uses(spark, sf_dir, t.select("a", "b", d.alias("d")).select("a", "b", "d.status", F.round("d.score", 9).alias("score")))


def preset_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under presets of node weights."""
    t = _frame(spark, known.PRESET_DISTANCES, "preset string,a string,b string,d double").select("preset", "a", "b").join(_sets(spark, "a"), "a").join(_sets(spark, "b"), "b")
    out = None
    for preset in dict.fromkeys(r[0] for r in known.rows(known.PRESET_DISTANCES, 4)):
        d = scoring.sound_distance(F.col("a_labels"), F.col("b_labels"), catalog().system("descriptive"), preset)
        one = t.where(F.col("preset") == preset).select("preset", "a", "b", F.round(d["score"], 9).alias("score"))
        out = one if out is None else out.unionByName(one)
    return _set_uses(spark, sf_dir, out)


def feature_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _frame(spark, known.HOPS, "a string,b string,d int")
    t = t.select("a", "b", scoring.feature_distance(F.col("a"), F.col("b")).alias("hops"))
    uses = _label_uses(spark, sf_dir)
    for c in ("a", "b"):
        t = t.join(uses.toDF(c, f"uses_{c}"), c, "left").withColumn(f"uses_{c}", F.coalesce(f"uses_{c}", F.lit(0)))
    return t


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where tokens stop to resolve, in characters."""
    t = _frame(spark, known.DIAGNOSES, "token string,status string,prefix int,offending string").select("token")
    d = resolve.diagnose(t, "token", catalog()).select("token", "diagnosis.*")
    prefix = F.char_length(F.decode(F.substring(F.encode("token", "UTF-8"), F.lit(1), F.col("valid_prefix_bytes")), "UTF-8"))
    return d.select("token", "status", F.when(F.col("valid_prefix_bytes") > 0, prefix).otherwise(0).alias("prefix"), F.when(F.col("status") != "ok", F.col("offending")).alias("offending"))


def tone_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, onset, mid, offset) as the labels of toned vowels have them."""
    t = _frame(spark, known.TONES, "token string,onset int,mid int,offset int").select("token")
    f = resolve.resolve_types(t, catalog()).select("token", F.array_join("r.features", "|").alias("f"))
    return f.select("token", *(F.regexp_extract("f", f"tone-{x}-([1-5])", 1).cast("int").alias(x) for x in ("onset", "mid", "offset")))


def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two pairs with clusters, whether the first is nearer; a cluster is at no distance from itself, a tone across tiers."""
    t = _frame(spark, known.CLUSTERS, "a string,b string,c string,d string")
    near = typology.pair_distances(t, catalog()).select("a", "b", "c", "d", F.col("score").alias("s"))
    far = typology.pair_distances(near.withColumnsRenamed({"a": "a1", "b": "b1", "c": "a", "d": "b"}), catalog())
    more = spark.createDataFrame([("ai", "ai"), ("a", "³¹"), ("mbr", "mbr")], "a string, b string")
    own = typology.pair_distances(more, catalog()).select("a", "b", F.col("score").alias("s"), "comparability")
    return far.select(F.col("a1").alias("a"), F.col("b1").alias("b"), F.when(F.col("s") < F.col("score"), "nearer").otherwise("not nearer").alias("said")).unionByName(own.select("a", "b", F.concat_ws(" ", F.round("s", 1).cast("string"), "comparability").alias("said")))


def bundle_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of the published plain pairs: fully specified, so the distance is both bounds."""
    t = _frame(spark, known.DISTANCES, "system string,a string,b string,d double").where("system = 'distinctive'").select("a", "b")
    one = bundles.from_graphemes(t, "a", catalog()).withColumnRenamed("bundle", "x").drop("bundle_status")
    two = bundles.from_graphemes(one, "b", catalog()).withColumnRenamed("bundle", "y")
    return bundles.compare(two, "x", "y", catalog()).select("a", "b", *(F.round(f"comparison.{c}", 9).alias(c) for c in ("distance", "minimum", "maximum")), "comparison.comparability", "comparison.compatible")


TOY = """
@format_version 1
@model toy
@type categorical
@geometry clements-hume
# letters of event types
grapheme e vowel front close-mid unrounded
grapheme r consonant alveolar trill voiced
grapheme o vowel back close-mid rounded
grapheme i vowel front close unrounded
grapheme k consonant velar stop voiceless
feature this line says nothing
"""


# letter, class, height of vowels
COARSE = """
a vowel open
e vowel close-mid
i vowel close
o vowel close-mid
u vowel
y vowel close
b stop
d stop
g stop
k stop
p stop
t stop
f fricative
h fricative
s fricative
v fricative
z fricative
l approximant
r approximant
w approximant
m nasal
n nasal
"""


def _coarse() -> list[list[str]]:
    return [line.split() for line in COARSE.strip().split("\n")]


def segment_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, class, types, tokens): characters of documents in hierarchical classes, for those of the published valued examples."""
    chars = _read(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return corpus.partition_counts(chars, valued_catalog(), "phoible")


def coarse_catalog() -> Catalog:
    """The catalog with a model of letters by vowels with their heights and by manners."""
    rows = "".join(f"grapheme {g} {'vowel continuant' if label == 'vowel' else 'consonant ' + label} {' '.join(more)}\n" for g, label, *more in _coarse())
    return catalog().with_model(f"@model coarse\n@type categorical\n@geometry clements-hume\n{rows}")


def compatible_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, letter, grapheme, distance, rank): letters of nation names as bundles of any height, and what a coarse model lists for them."""
    letters = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.explode(F.array_distinct(_chars(F.col("n_name")))).alias("letter"))
    c = coarse_catalog()
    made = bundles.from_graphemes(letters, "letter", c, "coarse").where("bundle IS NOT NULL").withColumn("bundle", F.regexp_replace("bundle", "(^|;)vowel_height=[^;]*", "$1vowel_height=*"))
    return bundles.compatible_graphemes(made, "bundle", c, "coarse").select("nation", "letter", "grapheme", F.round("distance", 9).alias("distance"), F.col("rank").cast("long").alias("rank"))


def indistinct_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, na, nb): characters of documents that a coarse model of vowels and manners can't tell apart, with their uses.

    A vowel without a height is like every other one.
    """
    c = coarse_catalog()
    t = F.lower("text")
    counts = _read(spark, sf_dir, "documents").select(F.explode(F.split(t, "")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    pairs = corpus.zero_pairs(counts, c, "coarse").select("a", "b")
    return pairs.join(counts.toDF("a", "na"), "a").join(counts.toDF("b", "nb"), "b").select("a", "b", "na", "nb")


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The systems in order, how many graphemes they list, and what they read of the characters of documents."""
    chars = _read(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return catalog().table(spark).join(corpus.coverage(chars, catalog(), SYSTEMS), "system")


def registered_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of event types under a model that is registered at run time."""
    manifest = {"name": "toy", "version": "1", "source": "this query", "interpretation": "five letters", "license": "none"}
    c = catalog().with_model(TOY, manifest)
    counts = _read(spark, sf_dir, "events").select(F.explode(F.split("event_type", "")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return resolve.resolve(counts, "token", c, "toy").select("token", "n", "status", F.array_join("r.features", " ").alias("labels"))


def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, kind, node, depth, n): labels of the model that is registered at run time, where they score, and their uses in event types."""
    c = catalog().with_model(TOY)
    counts = _read(spark, sf_dir, "events").select(F.explode(F.split("event_type", "")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    uses = resolve.resolve(counts, "token", c, "toy").select(F.explode("r.features").alias("label"), "n").groupBy("label").agg(F.sum("n").alias("n"))
    return corpus.label_reach(c.inventory(spark, "toy")).join(uses, "label").withColumn("depth", F.coalesce("depth", F.lit(-1)))


def turns_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of conversations as escaped TSV lines."""
    t = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return sinks.as_tsv(t).withColumnRenamed("value", "line")


# --- fixed examples weighed by their uses: a row's score stands beside how often its signs occur in documents


def _uses(spark: SparkSession, sf_dir: str, signs: list[str]) -> DataFrame:
    """(sign, uses): occurrences in all documents, in lower case, from left to right, without a row for each."""
    t = F.lower("text")
    counts = [(F.sum(F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))) / len(x)).cast("long").alias(f"s{i}") for i, x in enumerate(signs)]
    wide = _read(spark, sf_dir, "documents").agg(*counts)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(x).alias("sign"), F.col(f"s{i}").alias("uses")) for i, x in enumerate(signs)))).alias("t")).select("t.*")


def _weighed(query: Callable[[SparkSession, str], DataFrame], signs: list[str], columns: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    """The query's rows with uses_<column> for each of these columns of signs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out, uses = query(spark, sf_dir), _uses(spark, sf_dir, signs)
        for c in columns:
            # one row a sign, as many as the fixed examples have
            out = out.join(F.broadcast(uses.toDF(c, f"uses_{c}")), c, "left").withColumn(f"uses_{c}", F.coalesce(f"uses_{c}", F.lit(0).cast("long")))
        return out

    return run


def _weighed_sql(sql_text: str, signs: list[str], columns: list[str]) -> str:
    rows = ", ".join("('" + x.replace("'", "''") + "')" for x in signs)
    joins = " ".join(f"LEFT JOIN uses u{i} ON u{i}.sign = q.{c}" for i, c in enumerate(columns))
    return f"""
        WITH signs(sign) AS (VALUES {rows}),
        uses AS (SELECT sign, sum((length(lower(text)) - length(replace(lower(text), sign, ''))) // length(sign))::BIGINT AS uses FROM documents CROSS JOIN signs GROUP BY sign)
        SELECT q.*, {", ".join(f"coalesce(u{i}.uses, 0) AS uses_{c}" for i, c in enumerate(columns))} FROM ({sql_text}) q {joins}"""


def _signs(text: str, width: int, *at: int) -> list[str]:
    return sorted({r[k] for r in known.rows(text, width) for k in at})


#: Of each query: the signs that its rows are about, and the columns that they are in.
WEIGHED: dict[str, tuple[list[str], list[str]]] = {
    "segment_distance_distinctive": (list(LETTERS), ["a", "b"]),
    "segment_distance_descriptive": (list(LETTERS), ["a", "b"]),
    "nearest_letter": (list(LETTERS), ["a", "b"]),
    "orderings": (list(LETTERS), ["a", "b", "c"]),
    "feature_vectors": (list(LETTERS), ["token"]),
    "feature_vectors_descriptive": (list(LETTERS), ["token"]),
    "published_distances": (_signs(known.DISTANCES, 4, 1, 2), ["a", "b"]),
    "valued_distances": (_signs(known.VALUED_DISTANCES, 4, 1, 2), ["a", "b"]),
    "published_features": (_signs(known.FEATURES, 2, 0), ["grapheme"]),
    "diagnoses": (_signs(known.DIAGNOSES, 4, 0), ["token"]),
    "tone_levels": (_signs(known.TONES, 4, 0), ["token"]),
    "cluster_order": (sorted({*_signs(known.CLUSTERS, 4, 0, 1), "ai", "a", "mbr", "³¹"}), ["a", "b"]),
    "bundle_bounds": (_signs(known.DISTANCES, 4, 1, 2), ["a", "b"]),
}

FLAGSHIP = letter_contrast
VECTORS = {"distinctive": "", "descriptive": "_descriptive"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "letter_contrast": letter_contrast,
    "letter_frequency": letter_frequency,
    "segment_distance_distinctive": segment_distance("distinctive"),
    "segment_distance_descriptive": segment_distance("descriptive"),
    "nearest_letter": nearest_letter,
    "sample_composition": sample_composition,
    "segment_frequency": segment_frequency,
    "most_common_segments": most_common_segments,
    "readability": readability,
    "inventory_comparison": inventory_comparison,
    "feature_economy": feature_economy,
    "coverage": coverage,
    "blocked_datasets": blocked_datasets,
    "form_parse_rate": form_parse_rate,
    "contrast_audit": contrast_audit,
    "orderings": orderings,
    "pair_costs": pair_costs,
    "calibration": calibration,
    "cross_validated": cross_validated,
    "tokens_ascii": tokens_ascii,
    "segment_status": segment_status,
    **{f"feature_vectors{tail}": feature_vectors(s) for s, tail in VECTORS.items()},
    "system_tokens": system_tokens,
    "word_diagnoses": word_diagnoses,
    "word_alignments": word_alignments,
    "gap_accuracy": gap_accuracy,
    "paired_interval": paired_interval,
    "turn_segments": turn_segments,
    "unread_turns": unread_turns,
    "toned_syllables": toned_syllables,
    "published_distances": published_distances,
    "valued_distances": valued_distances,
    "published_features": published_features,
    "set_distances": set_distances,
    "preset_distances": preset_distances,
    "feature_hops": feature_hops,
    "diagnoses": diagnoses,
    "tone_levels": tone_levels,
    "cluster_order": cluster_order,
    "bundle_bounds": bundle_bounds,
    "registered_model": registered_model,
    "model_labels": model_labels,
    "indistinct_characters": indistinct_characters,
    "compatible_letters": compatible_letters,
    "segment_classes": segment_classes,
    "systems": systems,
    "turns_tsv": turns_tsv,
}


def _vector_values(system: str = "distinctive") -> str:
    s, rows = catalog().system(system), _labels()
    out = []
    for x in LETTERS:
        f = set(rows[x])
        v = [1.0 if f & set(d.positive) else -1.0 if f & set(d.negative) else 0.0 for d in s.binary]
        v += [0.0 if (i := c.level(f)) is None else (i + 1) / len(c.levels) for c in s.ordinal]
        v += [1.0 if y in f else -1.0 if f & set(g) else 0.0 for _, g in s.grouped for y in g]
        out += [f"('{x}', {k}, {y!r})" for k, y in enumerate(v) if y]
    return ", ".join(out)


def _values(text: str, kinds: str) -> str:
    """A block of fixed values as SQL rows: s a string, d a number."""
    quoted = lambda x, k: x if k == "d" else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quoted(x, k) + ("::DOUBLE" if k == "d" else "") for x, k in zip(r, kinds)) + ")" for r in known.rows(text, len(kinds)))


#: Accented Latin letters apart from their marks, by Unicode's own rule, as entries of a map.
_DECOMPOSED = ", ".join(f"('{chr(i)}', '{d}')" for i in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(i))) > 1)
_MARKS = "".join(map(chr, range(0x300, 0x370)))
_DIGRAPHS = "bv dz gb kp kx mb nd pf ts".split()
_PITCHES = "(regexp_matches({0}, '[áéíóú]')::INT + regexp_matches({0}, '[àèìòù]')::INT + regexp_matches({0}, '[âêîôû]')::INT)"
def _mixed(c: str) -> str:
    """32 bits of a number, mixed."""
    low = f"(({c}) & 4294967295)"
    return f"((xor({low}, {low} >> 16) * {0x2C1B3C6D}) & 4294967295)"


#: Letters of the coarse model, and these with an accent, which is a class of its own.
_COARSE_VALUES = ", ".join(f"('{c}', '{label}{mark}', {repr(more[0]) if more else 'NULL'})" for g, label, *more in _coarse() for mark in ["", *"\u0300\u0301\u0302\u0303\u0308"] if len(c := unicodedata.normalize("NFC", g + mark)) == 1)
_TOY_ROWS = ", ".join(f"('{w[1]}', '{' '.join(w[2:])}')" for w in map(str.split, TOY.strip().split("\n")) if w[0] == "grapheme")
_LIST_LETTERS = ", ".join(f"('{x}')" for x in LETTERS)
_FREQ = f"""
        letters(letter) AS (VALUES {_LIST_LETTERS}),
        freq AS (
            SELECT lang, letter, sum(length(lower(text)) - length(replace(lower(text), letter, '')))::BIGINT AS n
            FROM documents CROSS JOIN letters GROUP BY lang, letter HAVING n > 0)"""
#: Words (w) of NFD texts apart, with tone digits raised; then their tokens, as `segment_ipa` cuts them.
_NFD = f"translate(array_to_string(list_transform(string_split({{0}}, ''), lambda c: coalesce(m[c], c)), ''), '012345', '⁰¹²³⁴⁵')"
_TOKENS = f"regexp_extract_all({{0}}, '[⁰¹²³⁴⁵]+|[+.|]|[^⁰¹²³⁴⁵+.|{_MARKS}][{_MARKS}]*|[{_MARKS}]+')"
#: Words of parts and conversations, how far each reads as one segment, and what stops it.
_DIAGNOSED = f"""
        WITH t AS (
            SELECT 'part' AS source, unnest(regexp_split_to_array(lower(p_name), '\\s+')) AS word FROM part
            UNION ALL SELECT 'conversations', unnest(regexp_split_to_array(lower(text), '\\s+')) FROM conversations),
        w AS (
            SELECT source, word, count(*) AS n, translate(word, 'ñ', 'n') AS base, regexp_extract(word, '^[aeiouyäëïöüáéíóúàèìòùâêîôû]*') AS v
            FROM t WHERE word <> '' GROUP BY source, word),
        -- of vowels up to three with one pitch mark at most; of consonants up to three, pairs that are listed counting once
        p AS (
            SELECT *, list_max(list_filter([0, 1, 2, 3], lambda k: k <= length(v) AND {_PITCHES.format("v[1:k]")} <= 1)) AS k,
                   length(regexp_extract(base, '^(?:{"|".join(_DIGRAPHS)}|[bcdfghjklmnpqrstvwxz]){{1,3}}')) AS c FROM w),
        g AS (SELECT *, CASE WHEN word[1] = 'ç' THEN 1 ELSE greatest(k, c) END AS prefix FROM p),
        s AS (
            SELECT *, word[prefix + 1:prefix + 1] AS offending,
                   CASE WHEN prefix = length(word) THEN 'ok' WHEN v = word AND length(v) <= 3 THEN 'parse-error' ELSE 'unknown-grapheme' END AS status FROM g)"""
_ALIGNED = f"""
        WITH RECURSIVE {_distance_ctes("distinctive")},
        c AS (SELECT map(list(a || ' ' || b), list(score)) AS c FROM dist WHERE a <> b),
        d AS (SELECT map_from_entries([{_DECOMPOSED}]) AS m),
        w AS (SELECT list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM conversations),
        q AS (SELECT x, y, count(*) AS n FROM (SELECT unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM w WHERE len(w) > 1) GROUP BY x, y),
        s AS (SELECT x, y, n, {_TOKENS.format(_NFD.format("x"))} AS s1, {_TOKENS.format(_NFD.format("y"))} AS s2 FROM q, d),
        k AS (
            SELECT s.*, gap, [[CASE WHEN s1[i] = s2[j] THEN 0 ELSE coalesce(c[s1[i] || ' ' || s2[j]], 1) END FOR j IN range(1, len(s2) + 1)] FOR i IN range(1, len(s1) + 1)] AS cost
            FROM s, c, (SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS gap)),
        -- a row of the table at a time; the last one's running minimum stands for steps along the row
        r AS (
            SELECT x, y, n, gap, cost, len(s1) AS p, len(s2) AS q, 0 AS i, [[j * gap FOR j IN range(len(s2) + 1)]] AS best FROM k
            UNION ALL
            SELECT x, y, n, gap, cost, p, q, i + 1, list_append(best, [list_min([t[h + 1] + (j - h) * gap FOR h IN range(j + 1)]) FOR j IN range(q + 1)])
            FROM (SELECT *, list_prepend((i + 1) * gap, [least(best[i + 1][j] + cost[i + 1][j], best[i + 1][j + 1] + gap) FOR j IN range(1, q + 1)]) AS t FROM r WHERE i < p)),
        b AS (
            SELECT x, y, n, gap, cost, best, p AS i, q AS j, p, q, []::VARCHAR[] AS cols FROM r WHERE i = p
            UNION ALL
            SELECT x, y, n, gap, cost, best, CASE way WHEN 2 THEN i ELSE i - 1 END, CASE way WHEN 1 THEN j ELSE j - 1 END, p, q,
                   list_prepend(CASE way WHEN 2 THEN '-1' ELSE (i - 1)::VARCHAR END || ':' || CASE way WHEN 1 THEN '-1' ELSE (j - 1)::VARCHAR END, cols)
            FROM (
                SELECT *, CASE WHEN i > 0 AND j > 0 AND abs(best[i + 1][j + 1] - best[i][j] - cost[i][j]) < 1e-12 THEN 0
                               WHEN i > 0 AND abs(best[i + 1][j + 1] - best[i][j + 1] - gap) < 1e-12 THEN 1 ELSE 2 END AS way
                FROM b WHERE i > 0 OR j > 0))"""
_LABEL_USES = f"""{_FREQ},
        labels(letter, label) AS (VALUES {", ".join(f"('{x}', '{y}')" for x in LETTERS for y in _labels()[x])}),
        uses AS (SELECT label, sum(n)::BIGINT AS uses FROM freq JOIN labels USING (letter) GROUP BY label)"""
_SET_USES = f"""
        sets(name, labels) AS (VALUES {_values(known.SETS, 'ss')}),
        used AS (SELECT name, sum(uses)::BIGINT AS uses FROM (SELECT name, unnest(string_split(labels, '|')) AS label FROM sets) JOIN uses USING (label) GROUP BY name)"""
_SEGMENTS = """
        inv AS (SELECT n_nationkey::BIGINT AS inventory, n_regionkey AS region, regexp_extract_all(lower(n_name), '[a-z]') AS segs FROM nation),
        seg AS (SELECT inventory, region, unnest(segs) AS s, unnest(range(len(segs))) AS pos FROM inv)"""
_PART_TOKENS = """
        tok AS (
            SELECT p_type AS dataset, unnest(string_split(lower(regexp_replace(p_name || p_brand, '[^A-Za-z0-9]', '', 'g')), '')) AS token FROM part)"""

ORACLE_SQL: dict[str, str] = {
    "letter_frequency": f"WITH {_FREQ} SELECT lang, letter, n FROM freq",
    "letter_contrast": f"""
        WITH {_FREQ}, {_distance_ctes("distinctive")},
        w AS (
            SELECT x.lang, x.letter AS a, y.letter AS b, d.score, round(d.score * least(x.n, y.n), 6) AS weight
            FROM freq x JOIN freq y ON x.lang = y.lang AND x.letter < y.letter JOIN dist d ON d.a = x.letter AND d.b = y.letter)
        SELECT lang, a, b, round(score, 9) AS score, weight, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, a, b)::INT AS rank FROM w) WHERE rank <= 3""",
    **{f"segment_distance_{s}": f"WITH {_distance_ctes(s)} SELECT a, b, round(score, 9) AS score FROM dist" for s in SYSTEMS},
    "nearest_letter": f"""
        WITH {_distance_ctes("distinctive")}
        SELECT a, b, score, rank FROM (
            SELECT a, b, round(score, 9) AS score, row_number() OVER (PARTITION BY a ORDER BY round(score, 9), b) AS rank FROM dist WHERE a <> b)
        WHERE rank <= 2""",
    "sample_composition": """
        WITH j AS (
            SELECT s.s_suppkey, s.s_nationkey, coalesce(left(n.n_name, 1), '(unknown)') AS family, coalesce(r.r_name, '(unknown)') AS area
            FROM supplier s LEFT JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey < 4) ON s.s_nationkey = n.n_nationkey)
        SELECT 'total' AS level, 'inventories' AS name, count(*) AS n FROM j
        UNION ALL SELECT 'total', 'languages', count(DISTINCT s_nationkey) FROM j
        UNION ALL SELECT 'family', family, count(*) FROM j GROUP BY family
        UNION ALL SELECT 'area', area, count(*) FROM j GROUP BY area""",
    "segment_frequency": f"""
        WITH {_SEGMENTS}
        SELECT s AS segment, count(DISTINCT inventory) AS n, round(count(DISTINCT inventory) / (SELECT count(*) FROM nation), 9) AS share FROM seg GROUP BY s""",
    "most_common_segments": f"""
        WITH {_SEGMENTS}
        SELECT s AS segment, count(DISTINCT inventory) AS n, round(count(DISTINCT inventory) / (SELECT count(*) FROM nation), 9) AS share
        FROM seg GROUP BY s ORDER BY n DESC, segment LIMIT 10""",
    "readability": """
        SELECT inventory, regexp_replace(t, '[^a-z]', '', 'g') AS readable, regexp_replace(t, '[a-z]', '', 'g') AS unreadable
        FROM (SELECT DISTINCT p_brand AS inventory, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS t FROM part)""",
    "inventory_comparison": f"""
        WITH {_SEGMENTS}, {_distance_ctes("distinctive")},
        pairs AS (SELECT x.inventory AS a, y.inventory AS b FROM inv x JOIN inv y ON x.region = y.region AND x.inventory < y.inventory),
        ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        near AS (
            SELECT w.a, w.b, x.pos, min(CASE WHEN d.score < 1 THEN d.score END) AS m
            FROM ways w JOIN seg x ON x.inventory = w.a JOIN seg y ON y.inventory = w.b JOIN dist d ON d.a = x.s AND d.b = y.s GROUP BY w.a, w.b, x.pos),
        way AS (SELECT a, b, avg(coalesce(m, 1)) AS score, avg((m IS NOT NULL)::INT) AS coverage FROM near GROUP BY a, b)
        SELECT p.a, p.b, round((x.score + y.score) / 2, 9) AS score, round((x.coverage + y.coverage) / 2, 9) AS mean_coverage,
               'ok' AS comparability, (x.coverage + y.coverage) / 2 < 0.5 AS low_coverage
        FROM pairs p JOIN way x ON x.a = p.a AND x.b = p.b JOIN way y ON y.a = p.b AND y.b = p.a""",
    "feature_economy": f"""
        WITH {_SEGMENTS}, v(x, k, v) AS (VALUES {_vector_values()})
        SELECT inventory, count(DISTINCT s) AS n_segments, count(DISTINCT k) AS n_features, round(count(DISTINCT s) / count(DISTINCT k), 9) AS economy
        FROM seg JOIN v ON v.x = seg.s GROUP BY inventory""",
    "coverage": f"""
        WITH {_PART_TOKENS}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY token)
        SELECT s.system, count(*) AS types, sum((token SIMILAR TO '[a-z]')::INT)::BIGINT AS types_read, sum(n)::BIGINT AS tokens, sum(CASE WHEN token SIMILAR TO '[a-z]' THEN n ELSE 0 END)::BIGINT AS tokens_read
        FROM c CROSS JOIN (VALUES ('descriptive'), ('distinctive')) s(system) GROUP BY s.system""",
    "blocked_datasets": f"""
        WITH {_PART_TOKENS}
        SELECT dataset, count(*)::BIGINT AS tokens, sum((token SIMILAR TO '[a-z]')::INT)::BIGINT AS tokens_read, round(sum((token SIMILAR TO '[a-z]')::INT) / count(*), 9) AS share
        FROM tok GROUP BY dataset""",
    "form_parse_rate": """
        WITH f AS (SELECT p_brand AS dataset, unnest(string_split(lower(p_name || ' ' || p_size::VARCHAR), ' ')) AS word FROM part)
        SELECT dataset, count(*) AS forms, sum((word SIMILAR TO '[a-z]+')::INT)::BIGINT AS forms_read, round(sum((word SIMILAR TO '[a-z]+')::INT) / count(*), 9) AS rate
        FROM f WHERE word <> '' GROUP BY dataset""",
    "contrast_audit": f"""
        WITH {_distance_ctes("descriptive", "d1")}, {_distance_ctes("distinctive", "d2")},
        d AS (SELECT 'descriptive' AS system, * FROM d1 UNION ALL SELECT 'distinctive', * FROM d2),
        l AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]')) AS x FROM part)
        SELECT system, count(*) AS pairs, sum((score = 0)::INT)::BIGINT AS collapsed, count(DISTINCT round(score, 10)) AS distinct_distances
        FROM d WHERE a < b AND a IN (FROM l) AND b IN (FROM l) GROUP BY system""",
    "orderings": f"""
        WITH {_distance_ctes("descriptive", "d1")}, {_distance_ctes("distinctive", "d2")},
        d AS (SELECT 'descriptive' AS system, * FROM d1 UNION ALL SELECT 'distinctive', * FROM d2)
        SELECT x.a, x.b, y.b AS c, count(*) AS votes, sum((round(x.score, 10) < round(y.score, 10))::INT)::BIGINT AS nearer
        FROM d x JOIN d y ON x.system = y.system AND x.a = y.a AND x.b < y.b AND x.a <> x.b AND y.a <> y.b AND round(x.score, 10) <> round(y.score, 10)
        GROUP BY x.a, x.b, y.b HAVING count(*) >= 2""",
    "pair_costs": """
        WITH u AS (
            SELECT least(x, y) AS a, greatest(x, y) AS b FROM (
                SELECT lower(left(c_mktsegment, 1)) AS x, lower(substring(o_orderpriority, 3, 1)) AS y FROM orders JOIN customer ON o_custkey = c_custkey) WHERE y <> ''),
        n AS (SELECT a, b, count(*) AS n FROM u GROUP BY a, b),
        m AS (SELECT s, count(*)::DOUBLE AS m FROM (SELECT a AS s FROM u UNION ALL SELECT b FROM u) GROUP BY s),
        t AS (SELECT sum(m) AS total FROM m)
        SELECT n.a, n.b, n.n, CASE WHEN n.a = n.b THEN 0 ELSE round(x.m * y.m / (x.m * y.m + n.n * total), 9) END AS cost
        FROM n JOIN m x ON x.s = n.a JOIN m y ON y.s = n.b CROSS JOIN t""",
    "calibration": """
        WITH s AS (SELECT least(l_discount * 10, 1.0::DOUBLE) AS score, (l_returnflag = 'R')::INT AS matched FROM lineitem)
        SELECT least(floor(score * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(matched), 9) AS rate FROM s GROUP BY 1 HAVING count(*) >= 20""",
    "cross_validated": """
        WITH f AS (SELECT avg(o_totalprice) AS v FROM orders GROUP BY o_orderpriority)
        SELECT count(*) AS n, sum((v > 0)::INT)::BIGINT AS improved, round(avg(v), 4) AS mean, round(avg(v) - 1.96 * stddev_samp(v) / sqrt(count(*)), 4) AS low, round(avg(v) + 1.96 * stddev_samp(v) / sqrt(count(*)), 4) AS high FROM f""",
    "tokens_ascii": """
        SELECT token, count(*) AS n FROM (
            SELECT unnest(regexp_extract_all(translate(p_name || ' ' || p_brand, '012345', '⁰¹²³⁴⁵'), '[⁰¹²³⁴⁵]+|[^ ]')) AS token FROM part) GROUP BY token""",
    "segment_status": """
        SELECT status, count(*) AS types, sum(n)::BIGINT AS tokens FROM (
            SELECT CASE WHEN token IN ('_', '+', '#') THEN 'source-marker' WHEN token SIMILAR TO '[a-z]' THEN 'ok' ELSE 'unknown-grapheme' END AS status, token, count(*) AS n
            FROM (SELECT unnest(string_split(concat(event_type, props), '')) AS token FROM events) WHERE token <> '' GROUP BY token) GROUP BY status""",
    **{f"feature_vectors{tail}": f"WITH v(token, k, value) AS (VALUES {_vector_values(s)}) SELECT token, k::BIGINT AS k, round(value::DOUBLE, 9) AS value FROM v" for s, tail in VECTORS.items()},
    "system_tokens": f"""
        WITH w AS (
            SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word),
        d AS (
            SELECT n, {_NFD.format("word")} AS t
            FROM w, (SELECT map_from_entries([{_DECOMPOSED}]) AS m)),
        -- a bar ends each token; two tokens that are listed together are one
        o AS (SELECT n, array_to_string({_TOKENS.format("t")}, chr(31)) || chr(31) AS t FROM d),
        s AS (SELECT unnest(regexp_extract_all(t, '(?:{"|".join(chr(31).join(x) for x in _DIGRAPHS)}|[^' || chr(31) || ']+)' || chr(31))) AS segment, n FROM o)
        SELECT replace(segment, chr(31), '') AS segment, sum(n)::BIGINT AS n, count(*) AS types FROM s GROUP BY 1""",
    "word_diagnoses": f"""
        {_DIAGNOSED}
        SELECT source, word, n, prefix::INT AS prefix, offending, status FROM s""",
    "unread_turns": f"""
        {_DIAGNOSED}
        SELECT status, offending, sum(n)::BIGINT AS n FROM s WHERE source = 'conversations' GROUP BY status, offending""",
    "turn_segments": f"""
        WITH w AS (SELECT role, unnest(string_split(lower(text), ' ')) AS word FROM conversations),
        d AS (SELECT role, {_NFD.format("word")} AS t FROM w, (SELECT map_from_entries([{_DECOMPOSED}]) AS m)),
        o AS (SELECT role, array_to_string({_TOKENS.format("t")}, chr(31)) || chr(31) AS t FROM d),
        s AS (SELECT role, unnest(regexp_extract_all(t, '(?:{"|".join(chr(31).join(x) for x in _DIGRAPHS)}|[^' || chr(31) || ']+)' || chr(31))) AS segment FROM o)
        SELECT role, replace(segment, chr(31), '') AS segment, count(*) AS n FROM s GROUP BY 1, 2""",
    "word_alignments": f"{_ALIGNED} SELECT x, y, n, gap, array_to_string(cols, ' ') AS columns FROM b WHERE i = 0 AND j = 0",
    "gap_accuracy": f"""
        {_ALIGNED},
        g AS (
            SELECT gap, greatest(p, q) AS gold, len(cols) AS told,
                   len(list_intersect(cols, [CASE WHEN h < p THEN h ELSE -1 END || ':' || CASE WHEN h < q THEN h ELSE -1 END FOR h IN range(greatest(p, q))])) AS good
            FROM b WHERE i = 0 AND j = 0)
        SELECT gap, count(*) AS pairs, round(sum(good) / sum(gold), 9) AS column_accuracy, round(avg((good = gold AND told = gold)::INT), 9) AS perfect FROM g GROUP BY gap""",
    "paired_interval": f"""
        WITH l AS (SELECT (l_orderkey * 16 + l_linenumber)::BIGINT AS key, (l_discount - l_tax)::DOUBLE AS delta FROM lineitem WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL),
        a AS (SELECT delta, r, {_mixed("xor(key, key >> 32)")} + r * {0x297A2D39} + {7 * 0x1B56C4E9} AS x FROM l, (SELECT unnest(range(100)) AS r)),
        b AS (SELECT delta, r, {_mixed("x")} AS x FROM a), c AS (SELECT delta, r, {_mixed("x")} AS x FROM b), d AS (SELECT delta, r, xor(x, x >> 16) AS x FROM c),
        w AS (SELECT delta, r, {" + ".join(f"(x >= {int(p * (1 << 32))})::INT" for p in alignment.DRAWS)} AS w FROM d),
        m AS (SELECT sum(w * delta) / sum(w) AS mean FROM w GROUP BY r),
        o AS (SELECT list_sort(list(mean)) AS o FROM m)
        SELECT (SELECT count(*) FROM l) AS n, round((SELECT avg(delta) FROM l), 9) AS mean, round(o[3], 9) AS low, round(o[98], 9) AS high FROM o""",
    "toned_syllables": """
        WITH t AS (
            SELECT translate(((p_size % 25) // 5 + 1)::VARCHAR || (p_size % 5 + 1)::VARCHAR, '12345', '¹²³⁴⁵') AS tone, count(*) AS n FROM part GROUP BY 1)
        SELECT 'a' || tone AS token, 'a' AS base, tone, n FROM t
        UNION ALL SELECT x, x, NULL, (SELECT count(*) FROM part) FROM (VALUES ('m'), ('n')) v(x)""",
    "published_distances": f"SELECT system, a, b, round(d, 8) AS score FROM (VALUES {_values(known.DISTANCES, 'sssd')}) v(system, a, b, d)",
    "valued_distances": f"SELECT system, a, b, round(d, 9) AS score FROM (VALUES {_values(known.VALUED_DISTANCES, 'sssd')}) v(system, a, b, d)",
    "published_features": f"SELECT s.system, grapheme, 'ok' AS status, labels FROM (VALUES {_values(known.FEATURES, 'ss')}) v(grapheme, labels) CROSS JOIN (VALUES ('descriptive'), ('distinctive')) s(system)",
    "set_distances": f"""
        WITH {_LABEL_USES}, {_SET_USES}
        SELECT v.a, v.b, 'ok' AS status, round(d, 9) AS score, coalesce(x.uses, 0)::BIGINT AS uses_a, coalesce(y.uses, 0)::BIGINT AS uses_b
        FROM (VALUES {_values(known.SET_DISTANCES, 'ssd')}) v(a, b, d) LEFT JOIN used x ON x.name = v.a LEFT JOIN used y ON y.name = v.b""",
    "preset_distances": f"""
        WITH {_LABEL_USES}, {_SET_USES}
        SELECT preset, v.a, v.b, round(d, 9) AS score, coalesce(x.uses, 0)::BIGINT AS uses_a, coalesce(y.uses, 0)::BIGINT AS uses_b
        FROM (VALUES {_values(known.PRESET_DISTANCES, 'sssd')}) v(preset, a, b, d) LEFT JOIN used x ON x.name = v.a LEFT JOIN used y ON y.name = v.b""",
    "feature_hops": f"""
        WITH {_LABEL_USES}
        SELECT v.a, v.b, d::INT AS hops, coalesce(x.uses, 0)::BIGINT AS uses_a, coalesce(y.uses, 0)::BIGINT AS uses_b
        FROM (VALUES {_values(known.HOPS, 'ssd')}) v(a, b, d) LEFT JOIN uses x ON x.label = v.a LEFT JOIN uses y ON y.label = v.b""",
    "diagnoses": f"SELECT token, status, prefix::INT AS prefix, CASE WHEN status <> 'ok' THEN offending END AS offending FROM (VALUES {_values(known.DIAGNOSES, 'ssds')}) v(token, status, prefix, offending)",
    "tone_levels": f"SELECT token, onset::INT AS onset, mid::INT AS mid, o::INT AS offset FROM (VALUES {_values(known.TONES, 'sddd')}) v(token, onset, mid, o)",
    "cluster_order": f"""
        SELECT a, b, 'nearer' AS said FROM (VALUES {_values(known.CLUSTERS, 'ssss')}) v(a, b, c, d)
        UNION ALL SELECT * FROM (VALUES ('ai', 'ai', '0.0 ok'), ('mbr', 'mbr', '0.0 ok'), ('a', '³¹', '1.0 cross-tier')) w(a, b, said)""",
    "bundle_bounds": f"""
        SELECT a, b, round(d, 9) AS distance, round(d, 9) AS minimum, round(d, 9) AS maximum, 'ok' AS comparability, a = b AS compatible
        FROM (VALUES {_values(known.DISTANCES, 'sssd')}) v(system, a, b, d) WHERE system = 'distinctive'""",
    "segment_classes": f"""
        WITH v(system, g, cells) AS (VALUES {_values(known.VALUED_FEATURES, 'sss')}),
        f AS (SELECT g, map_from_entries([(string_split(x, '=')[1], string_split(x, '=')[2]) FOR x IN string_split(cells, '|')]) AS m FROM v WHERE system = 'phoible'),
        k AS (SELECT g, m, CASE WHEN m['syllabic'] = '+' THEN 'V' ELSE 'C' END AS kind FROM f),
        n AS (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(lower(text), '')) AS token FROM documents) GROUP BY token),
        p(level, kind, names) AS (VALUES
            ('coarse', 'C', 'sonorant continuant'), ('coarse', 'V', 'high low'), ('medium', 'C', 'sonorant continuant labial coronal dorsal'), ('medium', 'V', 'high low back'),
            ('fine', 'C', 'sonorant continuant labial coronal dorsal periodicGlottalSource'), ('fine', 'V', 'high low back round'))
        SELECT level, k.kind || ' ' || array_to_string([coalesce(m[x], '0') FOR x IN string_split(names, ' ')], '') AS class, count(*) AS types, sum(n)::BIGINT AS tokens
        FROM k JOIN n ON translate(n.token, 'äëïöñãõ', 'aeionao') = k.g JOIN p USING (kind) GROUP BY 1, 2""",
    "compatible_letters": f"""
        WITH m(c, label, height) AS (VALUES {", ".join(f"('{g}', '{label}', {repr(more[0]) if more else 'NULL'})" for g, label, *more in _coarse())}),
        l AS (SELECT DISTINCT n_nationkey::BIGINT AS nation, unnest(regexp_extract_all(lower(n_name), '[a-z]')) AS letter FROM nation)
        SELECT nation, letter, y.c AS grapheme, 0::DOUBLE AS distance, row_number() OVER (PARTITION BY nation, letter ORDER BY y.c) AS rank
        FROM l JOIN m x ON x.c = l.letter JOIN m y ON y.label = x.label""",
    "indistinct_characters": f"""
        WITH m(c, label, height) AS (VALUES {_COARSE_VALUES}),
        n AS (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(lower(text), '')) AS token FROM documents) GROUP BY token)
        SELECT x.c AS a, y.c AS b, i.n AS na, j.n AS nb FROM m x JOIN m y ON x.c < y.c AND x.label = y.label AND (x.height = y.height OR x.height IS NULL OR y.height IS NULL)
        JOIN n i ON i.token = x.c JOIN n j ON j.token = y.c""",
    "systems": """
        WITH c AS (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(lower(text), '')) AS token FROM documents) GROUP BY token),
        r AS (SELECT *, regexp_full_match(token, '[a-zäëïöüáéíóúàèìòùâêîôûñãõç]') AS good FROM c)
        SELECT * FROM (VALUES (0, 'descriptive', 'categorical', 'leaf', 68, 769), (1, 'distinctive', 'categorical', 'scalar', 64, 769))
            v(position, system, kind, scorer, width, listed),
            (SELECT count(*) AS types, sum(good::INT)::BIGINT AS types_read, sum(n)::BIGINT AS tokens, sum(CASE WHEN good THEN n ELSE 0 END)::BIGINT AS tokens_read FROM r)""",
    "registered_model": """
        WITH m(token, labels) AS (VALUES
            ('e', 'vowel front close-mid unrounded'), ('r', 'consonant alveolar trill voiced'), ('o', 'vowel back close-mid rounded'),
            ('i', 'vowel front close unrounded'), ('k', 'consonant velar stop voiceless')),
        c AS (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(event_type, '')) AS token FROM events) GROUP BY token)
        SELECT c.token, n, CASE WHEN m.token IS NOT NULL THEN 'ok' WHEN c.token = '_' THEN 'source-marker' ELSE 'unknown-grapheme' END AS status, labels
        FROM c LEFT JOIN m USING (token)""",
    "model_labels": f"""
        WITH RECURSIVE tree(node, parent) AS (VALUES {_values(tables.NODES, 'ss')}),
        r(node, depth) AS (SELECT 'Root', 0 UNION ALL SELECT t.node, r.depth + 1 FROM tree t JOIN r ON t.parent = r.node),
        m(token, labels) AS (VALUES {_TOY_ROWS}),
        l AS (SELECT token, unnest(string_split(labels, ' ')) AS label FROM m),
        w(label, node) AS (VALUES {", ".join(f"('{x}', '{y}')" for x, y in corpus.label_nodes())}),
        n AS (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(event_type, '')) AS token FROM events) GROUP BY token),
        u AS (SELECT label, sum(n)::BIGINT AS n FROM l JOIN n USING (token) GROUP BY label)
        SELECT label, CASE WHEN depth IS NOT NULL THEN 'scored' WHEN label IN ('vowel', 'consonant') THEN 'metadata' ELSE 'unknown' END AS kind, node, coalesce(depth, -1) AS depth, n
        FROM u LEFT JOIN (SELECT DISTINCT * FROM w) USING (label) LEFT JOIN r USING (node)""",
    "turns_tsv": r"""
        SELECT concat_ws(chr(9), conv_id::VARCHAR, turn::VARCHAR, coalesce(role, ''), coalesce(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), '')) AS line
        FROM conversations""",
}
for _name, (_of, _columns) in WEIGHED.items():
    QUERIES[_name] = _weighed(QUERIES[_name], _of, _columns)
    ORACLE_SQL[_name] = _weighed_sql(ORACLE_SQL[_name], _of, _columns)
