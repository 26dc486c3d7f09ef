"""Embedding near-duplicates by collision counting on one-dimensional projections.

Unit vectors of one label are projected on many random lines. On each line the vectors are sorted, and
a query collides with those in a window centred on it. For two vectors at the least cosine asked for,
a projection's difference is normal with a known spread, so the number of collisions over all lines is
binomial; the count that a pair must reach is the largest that such a pair still passes with
probability `recall`. Pairs that pass are verified by their exact cosine in double precision.

Equal vectors are one class with a multiplicity. A label of many classes isn't compared as a whole: each
of several tables sorts its classes into cells by the halves that some further lines' projections fall
into, as many tables as make a pair at the limit share a cell with probability `recall`. Cells hold a few
hundred classes whatever the label's size, so the work grows little faster than the classes. A pair
counts in the first table that brings it together. A cell (or a label of few classes, which is one) that
is larger than a block is dealt into blocks, and a task holds two of them. It sends links' counts by
class and a forest of links that connects what it found, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonospark.llm.common import HOT_KEYS, connected_components, cut, join_hot

MIN_COSINE, RECALL = 0.93, 0.9999
#: Lines, half width of a window in standard deviations of a limiting pair's difference, classes in a block.
LINES, WINDOW, BLOCK = 48, 1.0, 4096
#: Blocks of a label up to which it is one cell, and how many cells a block's worth of classes is cut into beyond.
WHOLE, CUT = 8, 8


def least_count(lines: int, window: float, recall: float) -> int:
    """The largest count that a pair at the limit reaches with probability `recall`."""
    p = math.erf(window / math.sqrt(2))
    tail, c = 0.0, lines
    for k in range(lines, -1, -1):
        tail += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if tail >= recall:
            c = k
            break
    return c


def directions(width: int, lines: int) -> np.ndarray:
    """The same normal directions in every task."""
    return np.random.default_rng(20240229).standard_normal((width, lines))


def collisions(q: np.ndarray, base: np.ndarray, half: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query row, counts over base rows); q and base are projections (rows, lines)."""
    order = np.argsort(base, axis=0, kind="stable")
    lo, hi = np.empty(q.shape, np.int64), np.empty(q.shape, np.int64)
    for k in range(q.shape[1]):
        values = base[order[:, k], k]
        lo[:, k], hi[:, k] = np.searchsorted(values, q[:, k] - half), np.searchsorted(values, q[:, k] + half, "right")
    columns = [np.ascontiguousarray(order[:, k]) for k in range(q.shape[1])]
    for i in range(len(q)):
        yield i, np.bincount(np.concatenate([c[a:b] for c, a, b in zip(columns, lo[i].tolist(), hi[i].tolist())]), minlength=len(base))


def compare(a: np.ndarray, b: np.ndarray, min_cosine: float, lines: int = LINES, window: float = WINDOW, recall: float = RECALL) -> Iterator[tuple[int, np.ndarray]]:
    """(row of a, rows of b at min_cosine or more); a and b hold unit vectors."""
    half = window * math.sqrt(max(0.0, 2 - 2 * min_cosine)) + 1e-9
    r, least = directions(a.shape[1], lines), least_count(lines, window, recall)
    for i, counts in collisions(a @ r, b @ r, half):
        near = np.flatnonzero(counts >= least)
        if len(near):
            near = near[b[near] @ a[i] >= min_cosine]
        if len(near):
            yield i, near


def halves(classes: int, block: int) -> int:
    """Lines by whose halves a label is cut into cells; none for a label of few classes."""
    return 0 if classes <= WHOLE * block else math.ceil(math.log2(classes * CUT / block))


def tables(lines: int, min_cosine: float, recall: float = RECALL) -> int:
    """Tables after which a pair at the limit has shared a cell with probability `recall`."""
    together = (1 - math.acos(min_cosine) / math.pi) ** lines
    return 1 if together == 1 else math.ceil(math.log(1 - recall) / math.log(1 - together))


def units(vectors: list) -> np.ndarray:
    v = np.array(vectors)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1))[:, None]


def routed(classes: DataFrame, min_cosine: float, block: int) -> DataFrame:
    """(class, label, n, v, table, cell, codes) for each cell of each class (class, label, n, v, classes)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (m, width), own in frame.groupby([frame["classes"].map(lambda k: halves(k, block)), frame["v"].map(len)]):
                t = tables(m, min_cosine)
                side = units(own["v"].tolist()) @ np.random.default_rng(20240301 + m).standard_normal((width, t * m)) > 0
                codes = (side.reshape(len(own), t, m) * (1 << np.arange(m))).sum(2)
                for at in range(t):
                    yield own[["class", "label", "n", "v"]].assign(table=at, cell=codes[:, at], codes=list(codes[:, : at + 1]))

    return classes.select("class", "label", "n", "v", "classes").mapInPandas(run, "class long, label string, n long, v array<double>, table int, cell long, codes array<long>")


def linked(embeddings: DataFrame, min_cosine: float = MIN_COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings (vec_id, embedding, label).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    rows whose label is null; nor do vectors of different width. Equal vectors of a label link with each
    other. Repeated rows count each. A null vec_id is the smallest of its component only if alone. Vectors
    are scaled before their lengths are taken, so very large and very small components do no harm. No rows
    give no rows; columns of embeddings other than these three aren't read, whatever their names.
    """
    e = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), e.alias("v"), F.coalesce(ok, F.lit(False)).alias("ok"))
    good = rows.where("ok").withColumn("class", F.xxhash64("label", "v")).withColumn("check", F.sha1(F.concat_ws(",", F.col("v").cast("array<string>"))))
    classes = cut(good.groupBy("class", "label", "check").agg(F.count("*").alias("n"), F.min("vec_id").alias("root"), F.first("v").alias("v")))
    sizes = cut(classes.groupBy("label").agg(F.count("*").alias("classes")))
    cells, place = routed(join_hot(classes, sizes, ["label"], "classes"), min_cosine, block), ["label", "table", "cell"]
    large = cut(cells.groupBy(*place).agg(F.count("*").alias("members")).where(F.col("members") > block))
    many = large.count()
    dealt = cells.join(F.broadcast(large) if many <= HOT_KEYS else large, place, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("members") / block), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class", F.lit(11)), F.col("blocks")).cast("int"))
    # each class goes to the tasks (own, other) as a query and (other, own) as data, own <= other
    pairs = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("class", *place, "codes", "n", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def task(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, table, _, i, j = key
        width = pdf["v"].map(len)
        out: list[tuple] = []
        for _, same in pdf.groupby(width):  # one group, unless widths differ
            v, codes = units(same["v"].tolist()), np.array(same["codes"].tolist())[:, :table]
            own, ids, n = same["own"].to_numpy(), same["class"].to_numpy(), same["n"].to_numpy()
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            links, top = np.zeros(len(same), np.int64), np.arange(len(same))
            for q, near in compare(v[a], v[b], min_cosine):
                near, at = b[near], a[q]
                near = near[(near != at) & ~(codes[near] == codes[at]).any(1)]  # not what has met before
                if not len(near):
                    continue
                links[at] += n[near].sum()
                if i != j:
                    links[near] += n[at]
                # point everything that hangs together here at one row
                roots = np.unique(np.append(top[near], top[at]))
                if len(roots) > 1:
                    top[np.isin(top, roots)] = roots[0]
            for k in np.flatnonzero(links):
                out.append((ids[k], ids[top[k]], links[k]))
        return pd.DataFrame(out, columns=["a", "b", "links"])

    found = cut(pairs.groupBy(*place, "i", "j").applyInPandas(task, "a long, b long, links long"))
    parts = cut(connected_components(found.select("a", "b")).select(F.col("node").alias("class"), "component"))
    lowest = parts.join(classes, "class").groupBy("component").agg(F.min("root").alias("low"))
    links = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    of = classes.select("class", "check", "label", "n", "root").join(parts.join(lowest, "component").select("class", "low"), "class", "left").join(links, "class", "left")
    of = of.select("class", "check", "label", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("low", "root").alias("component_id"))
    some = good.select("vec_id", "class", "check", "label").join(of, ["class", "check", "label"]).select("vec_id", "n_links", "component_id")
    none = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.union(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
