"""Sequence alignment under segment costs, and its evaluation."""

from __future__ import annotations

import random
from collections.abc import Iterator
from math import exp, factorial
from statistics import fmean

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAPS = (0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8)
COLUMNS = "array<struct<a:int,b:int>>"


#: Cells that one step of the batched alignment holds, over all pairs and gaps of a batch.
CELLS = 1 << 22
#: The most pairs of segments whose costs go to every task; beyond, each row brings the costs of its own.
BROADCAST_COSTS = 500_000


class Prices:
    """Costs of pairs of segments, looked up for many cells at once; equal segments cost nothing."""

    def __init__(self, a: list[str], b: list[str], score: list[float], missing: float) -> None:
        self.number: dict[str, int] = {}
        one, two = ([self.number.setdefault(x, len(self.number)) for x in xs] for xs in (a, b))
        self.width, self.missing = max(1, len(self.number)), missing
        key, at = np.unique((np.array(one, np.int64) * self.width + np.array(two, np.int64))[::-1], return_index=True)
        self.key, self.score = key, np.array(score, float)[::-1][at]

    def numbered(self, rows: list[list[str]]) -> list[list[int]]:
        """Segments by number; those without a cost get numbers of this batch."""
        held, more = self.number, {}
        return [[held[x] if x in held else self.width + more.setdefault(x, len(more)) for x in row] for row in rows]

    def cells(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = np.broadcast_arrays(x, y)
        out = np.full(x.shape, self.missing)
        known = (x < self.width) & (y < self.width) & (x >= 0) & (y >= 0)
        if len(self.key):
            key = x[known] * self.width + y[known]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out[known] = np.where(self.key[at] == key, self.score[at], self.missing)
        out[x == y] = 0.0
        return out


def needleman_wunsch(xs: list[list[int]], ys: list[list[int]], prices: Prices, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns of each alignment, places in the first, in the second; -1: a gap) for all pairs and all gaps, by pair.

    The cheapest global alignments; of equal ways diagonal, then up, then left. Cells of an anti-diagonal
    don't depend on each other, so one step fills it for all pairs and gaps.
    """
    n, m = (np.array([len(r) for r in rows]) for rows in (xs, ys))
    x, y = np.full((len(xs), max(1, n.max())), -1, np.int64), np.full((len(ys), max(1, m.max())), -2, np.int64)
    for rows, to in ((xs, x), (ys, y)):
        for k, row in enumerate(rows):
            to[k, : len(row)] = row
    cost = prices.cells(x[:, :, None], y[:, None, :])[:, None]
    rows, cols = int(n.max()), int(m.max())
    shape = (len(xs), len(gaps), rows + 1)
    g = gaps[None, :, None]
    ways = np.zeros((rows + cols + 1, *shape), np.uint8)  # by anti-diagonal and row: 0 diagonal, 1 up, 2 left
    before, last = np.zeros(shape), np.zeros(shape)
    for d in range(1, rows + cols + 1):
        here = np.full(shape, np.inf)
        i = np.arange(max(1, d - cols), min(rows, d - 1) + 1)
        if len(i):
            across, up, left = before[..., i - 1] + cost[:, :, i - 1, d - i - 1], last[..., i - 1] + g, last[..., i] + g
            best = np.minimum(np.minimum(across, up), left)
            here[..., i] = best
            ways[d][..., i] = np.where(np.abs(best - across) < 1e-12, 0, np.where(np.abs(best - up) < 1e-12, 1, 2))
        if d <= cols:
            here[..., 0], ways[d][..., 0] = d * gaps, 2
        if d <= rows:
            here[..., d], ways[d][..., d] = d * gaps, 1
        before, last = last, here
    i, j = (np.repeat(k[:, None], len(gaps), 1) for k in (n, m))
    pair, gap = np.indices(i.shape)
    a, b = (np.full((rows + cols, *i.shape), -2, np.int32) for _ in range(2))  # from the end; -2: none
    for step in range(rows + cols):
        on = (i > 0) | (j > 0)
        if not on.any():
            break
        way = ways[i + j, pair, gap, i]
        i, j = i - (on & (way != 2)), j - (on & (way != 1))
        a[step], b[step] = np.where(on, np.where(way != 2, i, -1), -2), np.where(on, np.where(way != 1, j, -1), -2)
    a, b = (z[::-1].transpose(1, 2, 0).reshape(pair.size, rows + cols) for z in (a, b))
    return (a != -2).sum(1), a[a != -2], b[b != -2]


ALIGNMENTS = f"array<struct<gap:double,columns:{COLUMNS}>>"


def batches_of(sizes: list[tuple[int, int]], gaps: int) -> Iterator[list[int]]:
    """Rows in groups of like sizes, each within CELLS or a single row."""
    group: list[int] = []
    n = m = 0
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        n, m = max(n, sizes[k][0]), max(m, sizes[k][1])
        if group and (len(group) + 1) * gaps * (n + 1) * (n + m + 1) > CELLS:
            yield group
            group, (n, m) = [], sizes[k]
        group.append(k)
    if group:
        yield group


def align_gaps(pairs: DataFrame, costs: DataFrame, gaps: tuple[float, ...] = GAPS, missing: float = 1.0, by: str | None = None) -> DataFrame:
    """pairs (s1, s2, ...) with `alignments`: (gap, columns) for every gap, in their order, from one pass over the pairs.

    costs (a, b, score) is a table over distinct segments, as scored once by `typology.distances`; with `by`, a
    column of both, each value has costs of its own. A table of more than BROADCAST_COSTS rows is joined to
    the pairs' own segments.
    """
    keys = [by] if by else []
    some = costs.select(*keys, "a", "b", "score").limit(BROADCAST_COSTS + 1).collect()
    few = len(some) <= BROADCAST_COSTS
    tables: dict = {}
    for r in some if few else []:
        for to, x in zip(tables.setdefault(r[by] if by else None, ([], [], [])), (r["a"], r["b"], r["score"])):
            to.append(x)
    sent = pairs.sparkSession.sparkContext.broadcast(tables)
    grid, held = np.array(gaps, float), {}
    told = pa.list_(pa.struct([("gap", pa.float64()), ("columns", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]))

    def priced(of) -> Prices:
        if of not in held:
            held[of] = Prices(*sent.value.get(of, ([], [], [])), missing)
        return held[of]

    @F.arrow_udf(ALIGNMENTS)
    def columns(s1: pa.Array, s2: pa.Array, of: pa.Array, own: pa.Array) -> pa.Array:
        of, own = of.to_pylist(), own.to_pylist()
        one, two = ([x or [] for x in c.to_pylist()] for c in (s1, s2))
        groups: dict = {}
        for k, x in enumerate(of):
            groups.setdefault(x, []).append(k)
        order, inner = [], []
        for x, rows in groups.items():
            if few:
                prices = priced(x)
            else:
                more = [m for k in rows for m in own[k]]
                prices = Prices([m["a"] for m in more], [m["b"] for m in more], [m["score"] for m in more], missing)
            numbers = prices.numbered([one[k] for k in rows] + [two[k] for k in rows])
            left, right = numbers[: len(rows)], numbers[len(rows) :]
            for part in batches_of([(len(p), len(q)) for p, q in zip(left, right)], len(grid)):
                size, a, b = needleman_wunsch([left[k] for k in part], [right[k] for k in part], prices, grid)
                ends = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                inner.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["a", "b"])))
                order += [rows[k] for k in part]
        if not order:
            return pa.array([], told)
        each = pa.StructArray.from_arrays([pa.array(np.tile(grid, len(order))), pa.concat_arrays(inner)], ["gap", "columns"])
        whole = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * len(grid)), each)
        return whole.take(pa.array(np.argsort(order))).cast(told)

    columns = columns.asNondeterministic()  # else it would run once more for each filter inferred from an explode
    none = F.array().cast("array<struct<a:string,b:string,score:double>>")
    of = F.col(by).cast("string") if by else F.lit(None).cast("string")
    if few:
        return pairs.withColumn("alignments", columns("s1", "s2", of, none))
    keyed = pairs.withColumn("_k", F.md5(F.to_json(F.struct(*keys, "s1", "s2"))))
    asked = keyed.dropDuplicates(["_k"]).select("_k", *keys, F.explode(F.array_distinct("s1")).alias("a"), F.array_distinct("s2").alias("ys")).select("_k", *keys, "a", F.explode("ys").alias("b"))
    found = asked.join(costs.select(*keys, "a", "b", "score"), [*keys, "a", "b"]).groupBy("_k").agg(F.collect_list(F.struct("a", "b", "score")).alias("_own"))
    return keyed.join(found, "_k", "left").withColumn("alignments", columns("s1", "s2", of, F.coalesce("_own", none))).drop("_k", "_own")


def align(pairs: DataFrame, costs: DataFrame, gap: float, missing: float = 1.0) -> DataFrame:
    """pairs (s1, s2, ...) with `columns`, the cheapest alignment at one gap; costs as for `align_gaps`."""
    return align_gaps(pairs, costs, (gap,), missing).withColumn("columns", F.get("alignments", F.lit(0))["columns"]).drop("alignments")


def each_gap(aligned: DataFrame) -> DataFrame:
    """A row of alignments as rows (all other columns, gap, columns)."""
    return aligned.select("*", F.inline("alignments")).drop("alignments")


def accuracy(aligned: DataFrame) -> DataFrame:
    """aligned (gold, columns) with right, gold_columns and perfect."""
    right = F.size(F.array_intersect("gold", "columns"))
    return aligned.withColumn("right", right).withColumn("gold_columns", F.size("gold")).withColumn("perfect", (right == F.size("gold")) & (F.size("gold") == F.size("columns")))


def evaluate(aligned: DataFrame) -> DataFrame:
    """(pairs, column_accuracy, perfect)."""
    return accuracy(aligned).agg(F.count("*").alias("pairs"), (F.sum("right") / F.sum("gold_columns")).alias("column_accuracy"), F.avg(F.col("perfect").cast("double")).alias("perfect"))


def gap_accuracy(dev: DataFrame, costs: DataFrame, grid: tuple[float, ...] = GAPS, missing: float = 1.0) -> DataFrame:
    """(gap, pairs, column_accuracy, perfect) for every gap, in one pass over dev (s1, s2, gold)."""
    told = accuracy(each_gap(align_gaps(dev, costs, grid, missing)))
    return told.groupBy("gap").agg(F.count("*").alias("pairs"), (F.sum("right") / F.sum("gold_columns")).alias("column_accuracy"), F.avg(F.col("perfect").cast("double")).alias("perfect"))


def tune_gap(dev: DataFrame, costs: DataFrame, grid: tuple[float, ...] = GAPS, missing: float = 1.0) -> float:
    """The gap of best column accuracy; of equal ones the smallest."""
    return gap_accuracy(dev, costs, grid, missing).orderBy(F.desc_nulls_last("column_accuracy"), "gap").first()["gap"]


# Fixed value: the chance of n draws or fewer of a row in a resample, which are Poisson(1), for each n.
DRAWS = [exp(-1) * sum(1 / factorial(k) for k in range(n + 1)) for n in range(13)]
_LOW = (1 << 32) - 1


def draws(rows: DataFrame, key: str, resample: str, seed: int = 7) -> DataFrame:
    """rows with `w`: how often each is in its resample, Poisson(1), a fixed function of key, resample and seed.

    key is a long of the row's own. 32 bits are mixed by shifts and products that keep within a long, and
    compared with DRAWS. Each step is a column, as its value is used more than once.
    """
    x, k = F.col("_x"), F.col(key).cast("long")

    def mixed(df: DataFrame) -> DataFrame:
        return df.withColumn("_x", x.bitwiseAND(F.lit(_LOW))).withColumn("_x", (x.bitwiseXOR(F.shiftrightunsigned(x, 16)) * 0x2C1B3C6D).bitwiseAND(F.lit(_LOW)))

    out = mixed(rows.withColumn("_x", k.bitwiseXOR(F.shiftrightunsigned(k, 32))))
    out = mixed(mixed(out.withColumn("_x", x + F.col(resample).cast("long") * 0x297A2D39 + seed * 0x1B56C4E9)))
    out = out.withColumn("_x", x.bitwiseXOR(F.shiftrightunsigned(x, 16)))
    return out.withColumn("w", sum(((x >= int(p * (1 << 32))).cast("int") for p in DRAWS), F.lit(0))).drop("_x")


def bootstrap_interval(rows: DataFrame, value: str, key: str, other: str | None = None, resamples: int = 400, seed: int = 7) -> DataFrame:
    """(n, mean, low, high): 95% interval of the mean of a column, or of its mean paired difference from `other`.

    For a table of any size: rows of a null value are left out, every row is weighed in each resample by
    `draws` of its key (a long, different in each row), and one aggregate sums weights and values. Nothing
    is collected; resamples' means, `resamples` numbers, are ordered in one row.
    """
    delta = F.col(value).cast("double") - (F.col(other).cast("double") if other else F.lit(0.0))
    t = rows.select(F.col(key).cast("long").alias("key"), delta.alias("delta")).where(F.col("delta").isNotNull())
    each = t.select("key", "delta", F.explode(F.sequence(F.lit(-1), F.lit(resamples - 1))).alias("r"))
    w = F.when(F.col("r") < 0, 1).otherwise(F.col("w"))
    sums = draws(each, "key", "r", seed).select("r", "delta", w.alias("w")).groupBy("r").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("delta")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    whole = lambda c: F.max(F.when(F.col("r") < 0, F.col(c)))
    out = sums.agg(whole("n").alias("n"), whole("mean").alias("mean"), F.sort_array(F.collect_list(F.when(F.col("r") >= 0, F.col("mean")))).alias("means"))
    at = lambda share: F.get("means", F.floor(F.lit(share) * F.size("means")).cast("int"))
    return out.select("n", "mean", at(0.025).alias("low"), at(0.975).alias("high"))


def bootstrap(values: list[float], others: list[float] | None = None, resamples: int = 400, seed: int = 7) -> tuple[float, float, float]:
    """(mean, low, high): 95% interval of the mean, or of the mean paired difference from `others`, by resampling.

    One value a pair of a bounded evaluation set, in a fixed order, as draws depend on it.
    """
    deltas = [x - y for x, y in zip(values, others, strict=True)] if others is not None else values
    rng, n = random.Random(seed), len(deltas)
    means = sorted(fmean(deltas[rng.randrange(n)] for _ in range(n)) for _ in range(resamples))
    return fmean(deltas), means[int(0.025 * resamples)], means[int(0.975 * resamples)]


def readable_pairs(pairs: DataFrame, readable: DataFrame) -> DataFrame:
    """pairs both of whose sequences hold only tokens of readable (token)."""
    keyed = pairs.withColumn("_k", F.md5(F.to_json(F.struct("s1", "s2"))))
    tokens = keyed.select("_k", F.explode(F.array_union("s1", "s2")).alias("token")).distinct()
    bad = tokens.join(readable.select("token").distinct(), "token", "left_anti").select("_k").distinct()
    return keyed.join(bad, "_k", "left_anti").drop("_k")


def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gold rows (pair, row, cells) with `-` for gaps to (pair, s1, s2, gold)."""
    for frame in frames:
        out = []
        for pair, group in frame.groupby("pair"):
            rows = group.sort_values("row")["cells"].tolist()
            if len(rows) < 2:
                continue
            at, gold = [0, 0], []
            for p, q in zip(*rows[:2]):
                i, j = (at[k] if c != "-" else -1 for k, c in enumerate((p, q)))
                at = [at[0] + (p != "-"), at[1] + (q != "-")]
                if i >= 0 or j >= 0:
                    gold.append({"a": i, "b": j})
            out.append((pair, [c for c in rows[0] if c != "-"], [c for c in rows[1] if c != "-"], gold))
        yield pd.DataFrame(out, columns=["pair", "s1", "s2", "gold"])


def gold_pairs(rows: DataFrame) -> DataFrame:
    """(pair, s1, s2, gold) from the two rows (row, cells) of each pair."""
    return rows.groupBy("pair").applyInPandas(lambda pdf: next(cells(iter([pdf]))), f"pair string, s1 array<string>, s2 array<string>, gold {COLUMNS}")
