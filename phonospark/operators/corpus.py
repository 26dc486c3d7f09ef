"""Corpora measured: coverage, contrast audits, orderings, pair statistics and calibration."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonospark.functions import geometry as G
from phonospark.functions import scoring, strings, tables
from phonospark.functions.geometry import DEFAULT_SYSTEM
from phonospark.operators import alignment
from phonospark.operators.resolve import resolve_types
from phonospark.operators.typology import distances
from phonospark.sources.catalog import Catalog


def coverage(counts: DataFrame, catalog: Catalog, systems: list[str]) -> DataFrame:
    """(system, types, types_read, tokens, tokens_read) of counts (token, n)."""
    totals = counts.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("n"))
    read = resolve_types(totals, catalog, *systems).join(totals, "token")
    ok = (F.col("status") == "ok").cast("int")
    return read.groupBy("system").agg(F.count("*").alias("types"), F.sum(ok).alias("types_read"), F.sum("n").alias("tokens"), F.sum(ok * F.col("n")).alias("tokens_read"))


def below_floor(measured: DataFrame, floors: DataFrame) -> DataFrame:
    """Systems whose share, rounded to two places, is under its floor (system, types_floor, tokens_floor)."""
    share = lambda a, b: F.round(100 * F.col(a) / F.col(b), 2)
    m = measured.select("system", share("types_read", "types").alias("types_share"), share("tokens_read", "tokens").alias("tokens_share"))
    return m.join(floors, "system").where((F.col("types_share") < F.col("types_floor")) | (F.col("tokens_share") < F.col("tokens_floor")))


def blocked(counts: DataFrame, catalog: Catalog, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """(dataset, tokens, tokens_read, share) of counts (dataset, token, n), worst first."""
    ok = (F.col("status") == "ok").cast("int")
    j = counts.join(resolve_types(counts, catalog, system), "token")
    out = j.groupBy("dataset").agg(F.sum("n").alias("tokens"), F.sum(ok * F.col("n")).alias("tokens_read"))
    return out.withColumn("share", F.col("tokens_read") / F.col("tokens")).orderBy("share", "dataset")


def form_parse_rate(forms: DataFrame, catalog: Catalog, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """(dataset, forms, forms_read, rate): forms all of whose segments the system reads."""
    each = forms.select("dataset", "form", F.explode("segments").alias("token"))
    whole = each.join(resolve_types(each, catalog, system), "token").groupBy("dataset", "form").agg(F.bool_and(F.col("status") == "ok").alias("read"))
    out = whole.groupBy("dataset").agg(F.count("*").alias("forms"), F.sum(F.col("read").cast("int")).alias("forms_read"))
    return out.withColumn("rate", F.col("forms_read") / F.col("forms"))


def contrast_audit(tokens: DataFrame, catalog: Catalog, systems: list[str]) -> DataFrame:
    """(system, pairs, collapsed, distinct_distances): unordered pairs, those at distance zero, different values."""

    def one(s: str) -> DataFrame:
        d = distances(tokens, catalog, s).where("a < b")
        return d.agg(F.count("*").alias("pairs"), F.sum((F.col("score") == 0).cast("int")).alias("collapsed"), F.count_distinct(F.round("score", 10)).alias("distinct_distances")).select(F.lit(s).alias("system"), "*")

    return reduce(DataFrame.unionByName, map(one, systems))


def zero_pairs(tokens: DataFrame, catalog: Catalog, system: str = DEFAULT_SYSTEM, preset: str | None = None) -> DataFrame:
    """(a, b, comparability): pairs of distinct readable tokens, a before b, at distance zero, without scoring all pairs.

    Two tokens can be at zero only if they are spellings of one grapheme, or agree in all places that count
    where one of them is silent and in those of the others (scales; all places of a valued system) where both
    speak. So tokens meet by an equi-join on what must be equal: the first kind of places, which of the
    others either is silent in, and the values in the rest. Each token stands once for every set of silent
    places that occurs among those it agrees with, which are few. What meets is scored.
    """
    s = catalog.system(system)
    places = scoring.plan(s, preset)
    loose = [k for k, (kind, w, _) in enumerate(places) if w and kind in (scoring.ORDINAL, scoring.VALUED)]
    strict = [k for k, (kind, w, _) in enumerate(places) if w and kind not in (scoring.ORDINAL, scoring.VALUED)]
    types = resolve_types(tokens, catalog, system).where(F.col("status") == "ok").select("token", scoring.prepare(F.col("r"), s).alias("p"))
    e = lambda k: F.get("p.e", F.lit(k))
    told = lambda xs: F.array_join(F.array(*(x.cast("string") for x in xs)), ",", "-") if xs else F.lit("")
    silent = F.array(*(e(k).isNull() for k in loose)) if loose else F.array().cast("array<boolean>")
    own = types.select("token", "p", F.concat_ws("/", F.col("p.tone").cast("string"), told([e(k) for k in strict])).alias("g"), silent.alias("own"))
    others = own.groupBy("g").agg(F.collect_set("own").alias("others"))
    each = own.join(others, "g").select("token", "p", "g", "own", F.explode("others").alias("other"))
    both = F.zip_with("own", "other", lambda x, y: x | y)
    values = F.zip_with(F.array(*(e(k) for k in loose)) if loose else F.array().cast("array<double>"), both, lambda v, no: F.when(~no, v).cast("string"))
    keyed = each.select("token", "p", "g", "own", "other", F.array_join(values, ",", "-").alias("v"))
    left = keyed.select(F.col("token").alias("a"), F.col("p").alias("x"), "g", "own", "other", "v")
    right = keyed.select(F.col("token").alias("b"), F.col("p").alias("y"), "g", F.col("other").alias("own"), F.col("own").alias("other"), "v")
    met = left.join(right, ["g", "own", "other", "v"]).where("a < b").select("a", "b", "x", "y")
    same = types.select(F.col("token").alias("a"), F.col("p").alias("x"), F.col("p.grapheme").alias("k")).join(types.select(F.col("token").alias("b"), F.col("p").alias("y"), F.col("p.grapheme").alias("k")), "k").where("a < b").select("a", "b", "x", "y")
    d = met.unionByName(same).select("a", "b", scoring.segment_distance(F.col("x"), F.col("y"), s, preset).alias("d"))
    return d.where("d.score = 0").select("a", "b", "d.comparability").distinct()


def fragile_pairs(tokens: DataFrame, catalog: Catalog, systems: list[str], declared: DataFrame | None = None) -> DataFrame:
    """(a, b, systems) at distance zero in more than one system; declared pairs (a, b) are left out."""
    zero = reduce(DataFrame.unionByName, (zero_pairs(tokens, catalog, s).select("a", "b", F.lit(s).alias("system")) for s in systems))
    out = zero.groupBy("a", "b").agg(F.array_sort(F.collect_set("system")).alias("systems")).where(F.size("systems") > 1)
    return out if declared is None else out.join(declared, ["a", "b"], "left_anti")


def contrast_baseline(forms: DataFrame, catalog: Catalog, system: str = DEFAULT_SYSTEM, declared: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(a, b, status) of the pairs of readable forms (token) at distance zero.

    status: spelling-equivalent or modifier-equivalent where both write the same thing, `uncompared` where
    no dimension is shared, `declared` for pairs of declared (a, b), else `undeclared`. Valued systems may
    be swept over an even sample of `most` forms in order, which is this measure's own definition.
    """
    forms = forms.select("token").distinct()
    if most is not None:
        ok = resolve_types(forms, catalog, system).where(F.col("status") == "ok").select("token")
        ranked = ok.select("token", F.row_number().over(Window.orderBy("token")).alias("i")).crossJoin(F.broadcast(ok.agg(F.count("*").alias("n"))))
        step = F.col("n") / F.lit(float(most))
        sampled = F.floor(F.ceil((F.col("i") - 1) / step) * step) == F.col("i") - 1
        forms = ranked.where((F.col("n") <= most) | sampled).select("token")
    d = zero_pairs(forms, catalog, system)
    d = d.join(declared.select("a", "b", F.lit(True).alias("known")), ["a", "b"], "left") if declared is not None else d.withColumn("known", F.lit(None).cast("boolean"))
    tone_a, tone_b = strings.contour(F.col("a")), strings.contour(F.col("b"))
    status = F.when(F.col("known"), "declared").when(tone_a == tone_b, "spelling-equivalent").when(strings.marks_key(F.col("a")) == strings.marks_key(F.col("b")), "modifier-equivalent")
    return d.select("a", "b", status.when(F.col("comparability") == "no-shared-dimension", "uncompared").otherwise("undeclared").alias("status"))


# Tones written with letters, and spellings of clusters that transcriptions use most.
TONE_LETTERS = "˩ ˨ ˧ ˦ ˥ ˥˩ ˩˥ ˧˥ ⁰"
CLUSTER_FORMS = "ai au ei ou aːi əu ui ia oi ɛi eu ɑi əi ɑu aɪ aːu ɔi uɔ aa ua ɐu ai̯ ao ɔu eɪ aʊ ae ea iɛ uə oa au̯ ɔɪ ie mb ɐi"


def bare_forms(spark) -> DataFrame:
    """(token): forms that no inventory lists: tones of one to three levels, tone letters and clusters."""
    tones = ["".join(x) for n in (1, 2, 3) for x in product("¹²³⁴⁵", repeat=n)]
    return spark.createDataFrame([(x,) for x in tones + TONE_LETTERS.split() + CLUSTER_FORMS.split()], "token string")


# Marks that composed forms are made with.
COMPOSED_SUFFIXES = "ː ːː ˑ \u0303 ʲ ʷ ˠ ˤ ʰ \u0325 ³³ ⁵⁵ ⁵¹ \u0308 \u033d ˞ \u0318 \u0319 \u032f \u0348 \u031a \u032c \u033a \u033b ʼ ⁿ ˡ"
COMPOSED_PREFIXES = "ʷ ʲ ᵐ"


def composed_forms(inventory: DataFrame, bases: int = 40) -> DataFrame:
    """(token): every k-th listed grapheme, `bases` of them, with each suffix and prefix."""
    w = Window.orderBy("grapheme")
    counted = inventory.select("grapheme").distinct().select("grapheme", (F.row_number().over(w) - 1).alias("i")).crossJoin(F.broadcast(inventory.agg(F.count_distinct("grapheme").alias("n"))))
    step = F.greatest(F.floor(F.col("n") / bases), F.lit(1))
    base = counted.where((F.col("i") % step == 0) & (F.col("i") < step * bases)).select("grapheme")
    ends = [F.concat("grapheme", F.lit(x)) for x in COMPOSED_SUFFIXES.split()] + [F.concat(F.lit(x), "grapheme") for x in COMPOSED_PREFIXES.split()]
    return base.select(F.explode(F.array(*ends)).alias("token")).distinct()


def dead_labels(catalog: Catalog, inventory: DataFrame, system: str) -> DataFrame:
    """(label): labels of the inventory that reach no dimension and aren't metadata."""
    s = catalog.system(system)
    read = {x for d in s.binary for x in d.positive + d.negative} | {x for c in s.ordinal for x in c.levels} | {x for _, g in s.grouped for x in g} | set(tables.METADATA)
    known = inventory.sparkSession.createDataFrame([(x,) for x in sorted(read)], "label string")
    return inventory.select(F.explode("features").alias("label")).distinct().join(F.broadcast(known), "label", "left_anti")


def unreachable(catalog: Catalog, inventory: DataFrame, system: str) -> DataFrame:
    """(dimension): dimensions that no listed grapheme sets."""
    s = catalog.system(system)
    of = [(d.name, x) for d in s.binary for x in d.positive + d.negative] + [(c.name, x) for c in s.ordinal for x in c.levels] + [(node, x) for node, g in s.grouped for x in g]
    dims = inventory.sparkSession.createDataFrame(of, "dimension string, label string")
    used = inventory.select(F.explode("features").alias("label")).distinct().join(F.broadcast(dims), "label").select("dimension")
    return dims.select("dimension").distinct().join(used, "dimension", "left_anti")


# The segments that orderings are swept over.
ORDERING_SEGMENTS = "p b t d k g m n ŋ s z f v ʃ ʒ h l r j w i e ɛ a ɔ o u y ø ə tʃ dʒ ts θ ð x ɣ q ʔ ɲ ʎ"


def orderings(tokens: DataFrame, catalog: Catalog, systems: list[str], least: int = 6) -> DataFrame:
    """(a, b, c, votes, nearer): over systems, how many say that a is nearer to b than to c (b < c)."""

    def one(s: str) -> DataFrame:
        # rounded, so that a vote doesn't hang on the order of a sum
        d = distances(tokens, catalog, s).where("a <> b").select("a", "b", F.round("score", 10).alias("score"))
        two = d.alias("x").join(d.alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.b") < F.col("y.b")))
        return two.where("x.score <> y.score").select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"), (F.col("x.score") < F.col("y.score")).cast("int").alias("nearer"))

    votes = reduce(DataFrame.unionByName, map(one, systems))
    return votes.groupBy("a", "b", "c").agg(F.count("*").alias("votes"), F.sum("nearer").alias("nearer")).where(F.col("votes") >= least)


def pair_costs(pairs: DataFrame) -> DataFrame:
    """(a, b, n, cost): aligned segments (x, y) as unordered pairs; equal ones cost nothing, others 1 / (1 + e^pmi).

    Chance is the product of both segments' shares of all aligned places.
    """
    return costs_of_counts(_pair_counts(pairs))


def _pair_counts(pairs: DataFrame, *by: str) -> DataFrame:
    u = pairs.select(*by, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return u.groupBy(*by, "a", "b").agg(F.count("*").alias("n"))


def costs_of_counts(n: DataFrame, *by: str) -> DataFrame:
    """(by, a, b, n, cost) of counted unordered pairs, each value of `by` on its own."""
    single = n.select(*by, F.explode(F.array("a", "b")).alias("s"), "n").groupBy(*by, "s").agg(F.sum("n").alias("m"))
    total = n.groupBy(*by).agg((2 * F.sum("n")).alias("total"))
    j = n.join(single.withColumnsRenamed({"s": "a", "m": "ma"}), [*by, "a"]).join(single.withColumnsRenamed({"s": "b", "m": "mb"}), [*by, "b"])
    j = j.join(total, list(by)) if by else j.crossJoin(F.broadcast(total))
    expected = F.col("ma").cast("double") * F.col("mb") / (F.col("total").cast("double") * F.col("total"))
    pmi = F.log(F.col("n") / F.col("total") / expected)
    return j.select(*by, "a", "b", "n", F.when(F.col("a") == F.col("b"), 0.0).otherwise(1 / (1 + F.exp(pmi))).alias("cost"))


def shrunk(n: Column, fitted: Column, prior: Column, k: float = 5.0) -> Column:
    """The fitted cost with weight n / (n + k), the prior for the rest."""
    w = F.coalesce(n, F.lit(0)) / (F.coalesce(n, F.lit(0)) + k)
    return w * F.coalesce(fitted, prior) + (1 - w) * prior


def calibration(scored: DataFrame, bins: int = 10, least: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bin, n, mean_score, rate) of (score, matched) in equal bins with enough rows."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    out = scored.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("matched").cast("double")).alias("rate"))
    return out.where(F.col("n") >= least)


def calibration_gap(bins_table: DataFrame, bins: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, gap): mean over bins of the difference between 1 less a bin's middle cost and its rate; null without bins."""
    return bins_table.groupBy(*by).agg(F.avg(F.abs(1 - (F.col("bin") + 0.5) / bins - F.col("rate"))).alias("gap"))


def cross_validated(folds: DataFrame) -> DataFrame:
    """(n, mean, low, high, improved) of a column `value`, one row a fold: mean and 1.96 standard errors."""
    half = 1.96 * F.stddev_samp("value") / F.sqrt(F.count("*"))
    return folds.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.avg("value") - half).alias("low"), (F.avg("value") + half).alias("high"), F.sum((F.col("value") > 0).cast("int")).alias("improved"))


def _segments(cols: Column) -> Column:
    """The pairs of segments that columns put together."""
    return F.transform(F.filter(cols, lambda c: (c["a"] >= 0) & (c["b"] >= 0)), lambda c: F.struct(F.get("s1", c["a"]).alias("x"), F.get("s2", c["b"]).alias("y")))


def predicted_pairs(aligned: DataFrame, costs: DataFrame, missing: float = 1.0, by: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, by, score, matched): each pair of segments that the gold or the alignment puts in one column, with its cost.

    Pairs count once a row of aligned (s1, s2, gold, columns), as segments. With `by`, columns of both tables,
    each value has costs of its own.
    """
    each = aligned.select(*keep, *by, _segments(F.col("gold")).alias("g"), _segments(F.col("columns")).alias("p")).select(*keep, *by, F.explode(F.array_union("p", "g")).alias("t"), "g")
    priced = each.select(*keep, *by, "t.x", "t.y", F.array_contains("g", F.col("t")).cast("int").alias("matched"))
    table = costs.select(*by, F.col("a").alias("x"), F.col("b").alias("y"), F.col("score").alias("own"))
    score = F.when(F.col("x") == F.col("y"), 0.0).otherwise(F.coalesce("own", F.lit(missing)))
    return priced.join(table, [*by, "x", "y"], "left").select(*keep, *by, score.alias("score"), "matched")


def leave_one_out(pairs: DataFrame, base: DataFrame, group: str = "family", k: float = 5.0, missing: float = 1.0, gaps: tuple[float, ...] = alignment.GAPS) -> DataFrame:
    """(held, gap_base, gap_fitted, accuracy_base, accuracy_fitted, change, calibration_base, calibration_fitted) for each group.

    pairs (group, s1, s2, gold), base (a, b, score). The costs that a group is tested with, and both gaps,
    come from the other groups alone: what is counted over all pairs, less what the group itself has. Groups
    are few (language families), and every pair is aligned once under the base costs and once under each
    group's fit, at all gaps together. All groups are fitted, tuned and tested in one plan.
    """
    pairs = pairs.withColumn("group", F.col(group).cast("string"))
    held = pairs.select(F.col("group").alias("held")).distinct()
    together = pairs.select("group", F.explode(_segments(F.col("gold"))).alias("t")).select("group", "t.*")
    own = _pair_counts(together, "group")
    whole = own.groupBy("a", "b").agg(F.sum("n").alias("n"))
    rest = whole.crossJoin(F.broadcast(held)).join(own.select(F.col("group").alias("held"), "a", "b", F.col("n").alias("less")), ["held", "a", "b"], "left")
    counts = rest.select("held", "a", "b", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")).where("n > 0")
    fitted = shrunk_costs(costs_of_counts(counts, "held"), base.crossJoin(F.broadcast(held)), k, missing, by=("held",))
    costs = base.select(F.lit("base").alias("set"), "a", "b", "score").unionByName(fitted.select(F.concat(F.lit("fit "), "held").alias("set"), "a", "b", "score"))

    sets = held.select("held", F.concat(F.lit("fit "), "held").alias("set")).unionByName(pairs.sparkSession.sql("SELECT CAST(NULL AS string) AS held, 'base' AS set"))
    aligned = alignment.align_gaps(pairs.crossJoin(F.broadcast(sets)), costs, gaps, missing, by="set")
    told = alignment.accuracy(alignment.each_gap(aligned))
    # counts of a set at a gap, of all groups and of each: a held group's training counts are the difference
    sums = told.groupBy("set", "held", "gap", "group").agg(F.sum("right").alias("right"), F.sum("gold_columns").alias("columns"))
    both = sums.where("held IS NOT NULL").select("held", "set", "gap", "group", "right", "columns").unionByName(sums.where("held IS NULL").drop("held").crossJoin(F.broadcast(held)).select("held", "set", "gap", "group", "right", "columns"))
    test = F.col("group") == F.col("held")
    less = lambda c: F.sum(c) - F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    tuned = both.groupBy("held", "set", "gap").agg((less("right") / F.nullif(less("columns"), F.lit(0))).alias("trained"), (F.sum(F.when(test, F.col("right"))) / F.sum(F.when(test, F.col("columns")))).alias("accuracy"))
    # the best training accuracy, of equal ones the smallest gap
    best = tuned.groupBy("held", "set").agg(F.max(F.struct(F.col("trained"), (-F.col("gap")).alias("less"), "accuracy")).alias("m")).select("held", "set", (-F.col("m.less")).alias("gap"), "m.accuracy")

    tested = pairs.withColumn("held", F.col("group")).join(F.broadcast(best.select("held", "set", F.col("gap").alias("chosen"))), "held")
    at_best = alignment.each_gap(alignment.align_gaps(tested, costs, gaps, missing, by="set")).where("gap = chosen")
    scored = calibration(predicted_pairs(at_best, costs, missing, by=("set",), keep=("held",)), by=("held", "set"))
    gap = calibration_gap(scored, by=("held", "set"))
    kind = F.when(F.col("set") == "base", "base").otherwise("fitted")
    joined = best.withColumnRenamed("gap", "best_gap").join(gap, ["held", "set"], "left")
    wide = joined.groupBy("held").agg(*(F.max(F.when(kind == s, F.col(c))).alias(f"{name}_{s}") for name, c in (("gap", "best_gap"), ("accuracy", "accuracy"), ("calibration", "gap")) for s in ("base", "fitted")))
    return wide.select("held", "gap_base", "gap_fitted", "accuracy_base", "accuracy_fitted", (F.col("accuracy_fitted") - F.col("accuracy_base")).alias("change"), "calibration_base", "calibration_fitted")


def shrunk_costs(fitted: DataFrame, base: DataFrame, k: float = 5.0, missing: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, a, b, score) in both orders: base where nothing was counted, else both by the number of times."""
    both = fitted.select(*by, "a", "b", "n", "cost").union(fitted.where("a <> b").select(*by, "b", "a", "n", "cost"))
    j = base.select(*by, "a", "b", "score").join(both, [*by, "a", "b"], "full")
    prior = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.coalesce("score", F.lit(missing)))
    return j.select(*by, "a", "b", shrunk(F.col("n"), F.col("cost"), prior, k).alias("score"))


# What a tone may cost against a segment in a sweep.
TONE_TARGETS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5, 2.0)


def _levels(c: Column) -> Column:
    return F.transform(F.split(c, ""), lambda x: F.element_at(F.create_map(*(F.lit(y) for kv in tables.CHAO.items() for y in kv)), x))


def tone_costs(tones: DataFrame) -> DataFrame:
    """(a, b, cost): mean difference of Chao levels of two tones, over four steps; the shorter one holds its last level."""
    t = tones.select("token", _levels(F.col("token")).alias("l")).distinct()
    n = F.greatest(F.size("x.l"), F.size("y.l"))
    padded = lambda l: F.concat(l, F.array_repeat(F.element_at(l, -1), n - F.size(l)))
    total = F.aggregate(F.zip_with(padded(F.col("x.l")), padded(F.col("y.l")), lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, v: s + v)
    both = t.alias("x").join(t.alias("y"), F.size("x.l") * F.size("y.l") > 0)
    return both.select(F.col("x.token").alias("a"), F.col("y.token").alias("b"), F.when(F.col("x.token") == F.col("y.token"), 0.0).otherwise(total / (4.0 * n)).alias("cost"))


def tone_sweep(dev: DataFrame, test: DataFrame, base: DataFrame, tones: DataFrame, targets: tuple[float, ...] = TONE_TARGETS, gaps: tuple[float, ...] = alignment.GAPS, missing: float = 1.0) -> DataFrame:
    """(target, gap, dev_accuracy, test_accuracy, test_perfect, saturated) for each cost of a tone against a segment.

    dev and test (s1, s2, gold) are split between alignments by the caller; base (a, b, score) prices two
    segments; tones (token) are all tones. saturated: from this cost on, all give the best test accuracy.
    """
    spark, out = dev.sparkSession, []
    priced = tone_costs(tones).select("a", "b", F.col("cost").alias("score"))
    segments = dev.union(test).select(F.explode(F.array_union("s1", "s2")).alias("token")).distinct().join(tones, "token", "left_anti")
    mixed = tones.select(F.col("token").alias("a")).distinct().crossJoin(segments.select(F.col("token").alias("b")))
    for target in targets:
        crossed = mixed.select("a", "b", F.lit(target).alias("score"))
        costs = base.select("a", "b", "score").union(priced).union(crossed).union(crossed.select("b", "a", "score"))
        gap = alignment.tune_gap(dev, costs, gaps, missing)
        d, t = (alignment.evaluate(alignment.align(x, costs, gap, missing)).first() for x in (dev, test))
        out.append((target, gap, d["column_accuracy"], t["column_accuracy"], t["perfect"]))
    top = max(r[3] for r in out)
    floor = min(r[0] for r in out if abs(r[3] - top) < 1e-12)
    return spark.createDataFrame([(*r, r[0] >= floor and abs(r[3] - top) < 1e-12) for r in out], "target double, gap double, dev_accuracy double, test_accuracy double, test_perfect double, saturated boolean")


def direction_tally(changes: DataFrame) -> DataFrame:
    """(dimension, up, down): sign changes of vectors (before, after). A count, not a cost: the sample's
    own skew is in it, so nothing here uses it as a default."""
    d = changes.select(F.posexplode(F.zip_with("before", "after", lambda x, y: F.signum(y - x))).alias("dimension", "sign"))
    return d.groupBy("dimension").agg(F.sum((F.col("sign") > 0).cast("int")).alias("up"), F.sum((F.col("sign") < 0).cast("int")).alias("down"))


def model_violations(inventory: DataFrame, system: G.System) -> DataFrame:
    """(grapheme, problem): empty rows, two levels of one scale, labels nobody knows."""
    f = F.col("features")
    known = F.array(*map(F.lit, sorted(G.scored_labels() | set(tables.METADATA))))
    problems = [F.when(F.size(f) == 0, "empty")]
    for s in system.ordinal:
        problems.append(F.when(F.size(F.array_intersect(f, F.array(*map(F.lit, s.levels)))) > 1, f"two levels of {s.name}"))
    if system.kind == "categorical":
        problems.append(F.when(F.size(F.array_except(f, known)) > 0, "unknown label"))
    return inventory.select("grapheme", F.explode(F.filter(F.array(*problems), lambda x: x.isNotNull())).alias("problem"))


def label_nodes() -> list[tuple[str, str]]:
    """Where labels score: (label, node of the tree)."""
    out = [(x, d.node) for d in G.leaves() for x in d.positive + d.negative] + [(x, s.node) for s in G.scales() for x in s.levels]
    return out + [(x, node) for node, labels in G.groups().items() for x in labels]


def label_reach(inventory: DataFrame, nodes: list[tuple[str, str]] | None = None) -> DataFrame:
    """(label, kind, node, depth): each label in use and where in the tree it scores.

    kind: scored; metadata, which scores nowhere by intent; unknown; or unreachable, where its node hangs on
    no path from Root. nodes: (node, parent), the built-in tree by default; its closure is a recursive query.
    """
    spark = inventory.sparkSession
    tree = spark.createDataFrame(nodes if nodes is not None else [tuple(x) for x in G.rows(tables.NODES)], "node string, parent string")
    reach = spark.sql("WITH RECURSIVE r(node, depth) AS (SELECT 'Root', 0 UNION ALL SELECT t.node, r.depth + 1 FROM {tree} t JOIN r ON t.parent = r.node) SELECT * FROM r", tree=tree)
    of = spark.createDataFrame(label_nodes(), "label string, node string").dropDuplicates(["label"])
    used = inventory.select(F.explode("features").alias("label")).distinct()
    j = used.join(F.broadcast(of), "label", "left").join(F.broadcast(reach), "node", "left")
    plain = F.col("label").isin(*tables.METADATA) | F.col("label").rlike("^(?:" + "|".join(tables.METADATA_PREFIXES) + ")")
    kind = F.when(F.col("depth").isNotNull(), "scored").when(F.col("node").isNotNull(), "unreachable").when(plain, "metadata").otherwise("unknown")
    return j.select("label", kind.alias("kind"), "node", "depth")


def row_hashes(inventory: DataFrame) -> DataFrame:
    """(grapheme, sha256) of each row: the grapheme and its labels in order, tab-separated."""
    return inventory.select("grapheme", F.sha2(F.concat_ws("\t", "grapheme", F.array_join(F.array_sort("features"), "|")), 256).alias("sha256"))


def provenance_violations(inventory: DataFrame, declared: DataFrame) -> DataFrame:
    """(grapheme, problem): rows that declared (grapheme, sha256) doesn't have, has otherwise, or has alone."""
    own, told = row_hashes(inventory), declared.select("grapheme", F.col("sha256").alias("told"))
    problem = F.when(F.col("told").isNull(), "undeclared").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("told"), "changed")
    return own.join(told, "grapheme", "full").select("grapheme", problem.alias("problem")).where("problem IS NOT NULL")


# Level, kind of segment (consonant or vowel), features whose values make a class.
PARTITIONS = """
coarse C sonorant continuant
coarse V high low
medium C sonorant continuant labial coronal dorsal
medium V high low back
fine C sonorant continuant labial coronal dorsal periodicGlottalSource
fine V high low back round
"""


def class_codes(features: Column, partitions: str = PARTITIONS) -> dict[str, Column]:
    """For each level the class of a valued segment: its kind, then the states of that level's features (absent: 0)."""
    state = lambda name: F.coalesce(F.get(F.transform(F.filter(features, lambda x: F.startswith(x, F.lit(f"{name}="))), lambda x: F.substring_index(x, "=", -1)), F.lit(0)), F.lit("0"))
    vowel, out = state("syllabic") == "+", {}
    for level, kind, *names in (line.split() for line in partitions.strip().split("\n")):
        code = F.concat(F.lit(f"{kind} "), *map(state, names))
        out[level] = F.when(vowel if kind == "V" else ~vowel, code) if level not in out else F.coalesce(out[level], F.when(vowel if kind == "V" else ~vowel, code))
    return out


def partition_counts(counts: DataFrame, catalog: Catalog, system: str, partitions: str = PARTITIONS) -> DataFrame:
    """(level, class, types, tokens): readable tokens of counts (token, n) by class on every level, in one pass.

    Levels are grouping sets over their codes, so each token's row is expanded once a level and summed where
    it lies before anything is moved.
    """
    types = resolve_types(counts, catalog, system).where(F.col("status") == "ok")
    codes = class_codes(F.col("r.features"), partitions)
    # one code a level; tokens are joined to their counts by type, few rows each
    told = types.select("token", *(c.alias(level) for level, c in codes.items()))
    rows = counts.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("n")).join(told, "token")
    levels = list(codes)
    sets = rows.groupingSets([[F.col(x)] for x in levels], *(F.col(x) for x in levels)).agg(F.grouping_id().alias("gid"), F.count("*").alias("types"), F.sum("n").alias("tokens"))
    level = None
    for i, x in enumerate(levels):
        gid = (1 << len(levels)) - 1 - (1 << (len(levels) - 1 - i))  # all others are rolled up
        level = F.when(F.col("gid") == gid, F.lit(x)) if level is None else level.when(F.col("gid") == gid, F.lit(x))
    return sets.select(level.alias("level"), F.coalesce(*levels).alias("class"), "types", "tokens")
