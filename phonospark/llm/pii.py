"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose spans: the strict ones of the contract, and looser ones (numbers without a country
code, cards run together, written-out addresses). Five labelers vote on each: the strict pattern, a
checksum or shape, a gazetteer (top-level domains, card issuers, area codes), the words before it, and
its borders. Votes are counted by pattern of votes over all documents, a table of at most a few hundred
rows; from it, expectation-maximisation estimates each labeler's reliability and each pattern's
probability, and these train the final span classifier, a logistic model over the votes. Looser spans
stay where the classifier says so and no strict span is touched; strict spans always stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonospark.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
# Possessive forms match the same text as the contract's patterns without stepping back, and starts are
# tried once for each run of characters: after the last match, or where no such character stands before.
STRICT = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARD = {EMAIL: "@", IP: r"[0-9]\.[0-9]++\.[0-9]", CARD: r"[0-9](?:[\x20-]?[0-9]){13}", PHONE: r"\+[0-9]"}
# A written-out address has parts of the lengths that mail and domain names allow: 64, and 63 eight times.
LOOSE = {
    EMAIL: r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,8}",
    CARD: r"(?<![0-9])[0-9]{14,19}(?![0-9])",
    PHONE: r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
LOOSE_GUARD = {EMAIL: r"[(\[]at[)\]]", CARD: r"[0-9]{14}", PHONE: r"[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}"}
# Gazetteers and words that stand before personal data.
GAZETTEER = {
    EMAIL: r"\.(?:com|org|net|edu|gov|info|biz|io|co|de|fr|es|uk|us|eu|it|nl|ch|at|be|br|mx|ar|ca|au|jp|cn|in|ru|pl|se|no|dk|fi|pt)$",
    IP: r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.",
    CARD: r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6)",
    PHONE: r"^(?:\+[1-9]|\(?[2-9])",
}
CONTEXT = {
    EMAIL: r"(?i)mail|contact|write|schreib|correo|courriel|to:",
    IP: r"(?i)\bip\b|host|server|address|from|adresse",
    CARD: r"(?i)card|visa|master|pay|karte|carte|tarjeta|account",
    PHONE: r"(?i)tel|phone|call|fax|mobile|ruf|appel|llam|contact",
}
LABELERS = ("strict", "check", "gazetteer", "context", "border")
ABSTAIN = 2
SPAN = "array<struct<start:bigint,end:bigint,kind:int,strict:boolean,votes:int>>"


#: Items in a chunk of a running fold: an array that grows is copied once for each item, so it stays short.
CHUNK = 64


def running(items: Column, value: Callable[[Column], Column], merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each item, the merged values of all items before it; in chunks, so that the work stays near linear."""
    extend = lambda s, v: F.concat(s, F.array(merge(F.element_at(s, -1), v)))
    n = F.size(items)
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.slice(items, i + 1, F.lit(CHUNK)))
    totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda s, x: merge(s, value(x))))
    starts = F.slice(F.aggregate(totals, F.array(zero), extend), F.lit(1), F.size(totals))
    inner = lambda c, z: F.slice(F.aggregate(c, F.array(z), lambda s, x: extend(s, value(x))), F.lit(1), F.size(c))
    return F.flatten(F.zip_with(chunks, starts, inner))


def located(text: Column, pattern: str, guard: str) -> Column:
    """array<struct<start, hit, before, after>> of the pattern's matches, leftmost first, in code points.

    before holds up to 30 characters since the last match, which is as far as the context labeler looks.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    n = F.size(hits)
    pieces = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, 2, F.greatest(n, F.lit(1))).alias("next")), lambda x: x["hit"].isNotNull())
    none = F.array().cast("array<struct<start:bigint,hit:string,before:string,after:string>>")

    def one(x: Column, passed: Column) -> Column:
        return F.struct((passed + F.char_length(x["gap"])).alias("start"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(30)).alias("before"), F.left(F.coalesce(x["next"], F.lit("")), F.lit(1)).alias("after"))

    def placed(own: Column) -> Column:
        passed = running(own, lambda x: (F.char_length(x["gap"]) + F.char_length(x["hit"])).cast("long"), lambda s, v: s + v, F.lit(0).cast("long"))
        return F.zip_with(own, passed, one)

    return F.when(text.rlike(guard), let(pieces, placed)).otherwise(none)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def outside(loose: Column, strict: Column) -> Column:
    """The loose spans that overlap no strict one: by start, how far strict spans before reach, and where the next starts."""
    both = F.array_sort(F.concat(strict, loose))
    far = F.lit(1 << 60).cast("long")

    def marked(spans: Column) -> Column:
        reach = running(spans, lambda x: F.when(x["strict"], x["end"]).otherwise(0), lambda s, v: F.greatest(s, v), F.lit(0).cast("long"))
        ahead = F.reverse(running(F.reverse(spans), lambda x: F.when(x["strict"], x["start"]).otherwise(far), lambda s, v: F.least(s, v), far))
        seen = F.arrays_zip(spans.alias("x"), reach.alias("reach"), ahead.alias("ahead"))
        free = F.filter(seen, lambda e: ~e["x"]["strict"] & (e["reach"] <= e["x"]["start"]) & (e["ahead"] >= e["x"]["end"]))
        return F.transform(free, lambda e: e["x"])

    return F.when((F.size(loose) > 0) & (F.size(strict) > 0), let(both, marked)).otherwise(loose)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Doubling every second digit from the right, digits of products added, ten divides the sum."""

    def part(c: Column, i: Column) -> Column:
        v = c.cast("int") * (1 + i % 2)
        return v - F.when(v > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(d), ""), part), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 10 == 0


def valid(kind: int, hit: Column) -> Column:
    """What the contract asks of a match beyond its pattern."""
    if kind == IP:
        return F.forall(F.split(hit, r"\."), lambda p: (F.char_length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.when(F.char_length(F.regexp_replace(p, "^0+", "")) <= 3, p.cast("decimal(38,0)")), F.lit(999)) <= 255))
    if kind == CARD:
        return F.char_length(digits(hit)).between(14, 19) & luhn(digits(hit))
    if kind == PHONE:
        return F.char_length(digits(hit)).between(10, 15)
    return F.lit(True)


def votes(kind: int, x: Column, strict: bool) -> Column:
    """Base-3 digits by labeler: 0 no, 1 yes, 2 no opinion."""
    hit = x["hit"]
    yes = lambda c: F.when(c, 1).otherwise(0)
    shape = {EMAIL: ~hit.rlike(r"^\.|\.\."), IP: ~hit.rlike(r"^0|\.0[0-9]"), CARD: luhn(digits(hit)), PHONE: F.char_length(digits(hit)).between(10, 15)}[kind]
    border = ~F.right(x["before"], F.lit(1)).rlike(r"[\p{L}\p{N}]") & ~x["after"].rlike(r"[\p{L}\p{N}]")
    found = (F.lit(int(strict)), yes(shape), yes(hit.rlike(GAZETTEER[kind])), F.when(x["before"].rlike(CONTEXT[kind]), 1).otherwise(ABSTAIN), yes(border))
    total = F.lit(0)
    for i, v in enumerate(found):
        total = total + v * 3**i
    return total.cast("int")


def spans_of(text: Column, kind: int, pattern: str, guard: str, strict: bool) -> Column:
    found = located(text, pattern, guard)
    if strict:
        found = F.filter(found, lambda x: valid(kind, x["hit"]))

    def span(x: Column) -> Column:
        end = x["start"] + F.char_length(x["hit"])
        return F.struct(x["start"].alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), votes(kind, x, strict).alias("votes"))

    return F.transform(found, span).cast(SPAN)


def proposals(text: Column) -> Column:
    """All strict and loose spans of a text, with their votes."""
    own = [spans_of(text, k, p, GUARD[k], True) for k, p in STRICT.items()]
    return F.concat(*own, *(spans_of(text, k, p, LOOSE_GUARD[k], False) for k, p in LOOSE.items()))


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 50) -> dict[tuple[int, int], float]:
    """Probability that a span with (kind, votes) is personal data, by EM over the counts of patterns.

    Each labeler has one rate of yes among true and one among false spans; a few imagined votes keep
    rates off zero and one and tell yes from no.
    """
    n = len(LABELERS)
    rates = [[0.8] * n, [0.3] * n]
    prior = dict.fromkeys(range(len(KINDS)), 0.7)
    split = {p: [p[1] // 3**i % 3 for i in range(n)] for p in counts}
    post: dict[tuple[int, int], float] = {}
    for _ in range(rounds):
        for p, v in split.items():
            like = []
            for true in (0, 1):
                a = prior[p[0]] if not true else 1 - prior[p[0]]
                for i, x in enumerate(v):
                    a *= 1.0 if x == ABSTAIN else rates[true][i] if x else 1 - rates[true][i]
                like.append(a)
            post[p] = like[0] / sum(like)
        for true, start in ((0, 0.8), (1, 0.3)):
            for i in range(n):
                yes, all_ = 10 * start, 10.0
                for p, v in split.items():
                    w = counts[p] * (post[p] if not true else 1 - post[p])
                    if v[i] != ABSTAIN:
                        yes, all_ = yes + w * v[i], all_ + w
                rates[true][i] = yes / all_
        for k in prior:
            own = [p for p in counts if p[0] == k]
            prior[k] = (7 + sum(counts[p] * post[p] for p in own)) / (10 + sum(counts[p] for p in own))
    return post


def classifier(counts: dict[tuple[int, int], int], post: dict[tuple[int, int], float], rounds: int = 400) -> list[float]:
    """Weights of a logistic model over the votes (yes +1, no -1, no opinion 0) and kinds, by descent."""
    rows = [(vote_features(k, v), post[k, v], counts[k, v] ** 0.5) for k, v in counts]
    total = sum(r[2] for r in rows) or 1.0
    w = [0.0] * (len(LABELERS) + len(KINDS))
    for _ in range(rounds):
        g = [0.002 * x for x in w]
        for f, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, f))))))
            for i, x in enumerate(f):
                g[i] += (p - y) * x * n / total
        w = [a - 0.5 * b for a, b in zip(w, g)]
    return w


def vote_features(kind: int, v: int) -> list[float]:
    return [0.0 if (x := v // 3**i % 3) == ABSTAIN else 1.0 if x else -1.0 for i in range(len(LABELERS))] + [float(kind == k) for k in range(len(KINDS))]


def probability(x: Column, w: list[float]) -> Column:
    total = F.lit(0.0)
    for i, a in enumerate(w[: len(LABELERS)]):
        vote = F.floor(x["votes"] / F.lit(3**i)) % 3
        total = total + F.when(vote == 1, a).when(vote == 0, -a).otherwise(0.0)
    for k, a in enumerate(w[len(LABELERS) :]):
        total = total + F.when(x["kind"] == k, a).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind, strict>>) for every row of docs, by start, then kind.

    Offsets count code points, the end excluded. Null and empty texts have no spans. Repeated rows count
    each in the labelers' statistics; a null doc_id is kept. With no spans anywhere, or no rows, nothing is
    trained. Loose spans that touch a strict one go; of equal starts spans are ordered by kind. Texts are
    read whole, in time near linear in their spans. Columns of docs other than doc_id and text aren't read,
    whatever their names.
    """
    found = cut(docs.select("doc_id", proposals(F.coalesce("text", F.lit(""))).alias("spans")))
    seen = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count().collect()  # bounded: kinds times 3 ** labelers
    counts = {(r["kind"], r["votes"]): r["count"] for r in seen}
    w = classifier(counts, reliabilities(counts))
    strict = F.filter("spans", lambda x: x["strict"])
    loose = F.filter("spans", lambda x: ~x["strict"] & (probability(x, w) >= least))
    both = found.select("doc_id", strict.alias("strict"), loose.alias("loose"))
    free = outside(F.col("loose"), F.col("strict"))
    order = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["strict"].alias("strict"))
    return both.select("doc_id", F.array_sort(F.transform(F.concat("strict", free), order)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and the written forms of strict spans (hashed) and of all spans."""
    base = F.filter("spans", lambda x: x["strict"])

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["strict"] & (x["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")

    counts = map(count, range(len(KINDS)))
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
