"""Compiled bundles: a cell is one number, a bundle an array of them, and comparing is arithmetic on bits.

A cell's number holds whether it may not apply (bit 0), may be any set of labels (1), is one of its labels
(2), and from bit 3 on which values it may have. Two bundles are one pass over two such arrays and a
constant array of the columns' kinds, weights and divisors; nothing is parsed and no Python runs.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from phonospark.functions import bundles as B
from phonospark.functions import scoring
from phonospark.functions.geometry import System, preset_weight

NA, ANY, ONE_OF, SHIFT = 1, 2, 4, 3
BINARY, VALUED, ORDINAL, GROUP = range(4)


def number(cell: B.Cell) -> int:
    return cell.mask << SHIFT | cell.na * NA | cell.any * ANY | cell.oneof * ONE_OF


def of_features(f: Column, system: System) -> Column:
    """array<bigint> of a plain segment's labels."""
    out = []
    for c in B.columns(system):
        if c.kind == "ordinal":
            level = scoring._level(f, next(s for s in system.ordinal if s.name == c.name))
            out.append(F.coalesce(F.pow(F.lit(2.0), level + SHIFT).cast("long"), F.lit(NA).cast("long")))
        elif c.kind == "group":
            bits = sum((F.when(F.array_contains(f, x), 1 << i).otherwise(0) for i, x in enumerate(c.labels)), F.lit(0)).cast("long")
            out.append(F.when(bits > 0, F.shiftleft(bits, SHIFT)).otherwise(NA))
        elif c.valued:
            cell = None
            for states, m in (("+", B.PLUS), ("-", B.MINUS), ("nox", B.NEUTRAL), ("?", B.PLUS | B.MINUS)):
                test = scoring._any(f, tuple(f"{c.name}={s}" for s in states))
                cell = F.when(test, m << SHIFT) if cell is None else cell.when(test, m << SHIFT)
            out.append(cell.otherwise(NA).cast("long"))
        else:
            out.append(F.when(scoring._any(f, c.positive), B.PLUS << SHIFT).when(scoring._any(f, c.negative), B.MINUS << SHIFT).otherwise(NA).cast("long"))
    return F.array(*out)


def of_text(c: Column, system: System) -> Column:
    """array<bigint> of bundle texts, null for one that is refused; each distinct text is parsed once a batch."""

    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        held = {}
        for t in texts.dropna().unique():
            try:
                held[t] = [number(x) for x in B.parse(system, t)]
            except (B.BadCell, KeyError):
                held[t] = None
        return texts.map(lambda t: None if t is None else held[t])

    return run(c)


def _places(system: System, preset: str | None) -> Column:
    """The columns' kinds, weights and divisors, one literal that is parsed when the query is planned."""
    kind = lambda c: {"ordinal": ORDINAL, "group": GROUP}.get(c.kind, VALUED if c.valued else BINARY)
    divisor = lambda c: float(len(c.labels) - 1) if c.kind == "ordinal" else 2.0 if c.valued else c.divisor
    rows = [{"k": kind(c), "w": preset_weight(c.node, c.weight, preset), "d": divisor(c)} for c in B.columns(system)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<k:int,w:double,d:double>>")


def _has(x: Column, flag: int) -> Column:
    return x.bitwiseAND(F.lit(flag)) != 0


def _mask(x: Column) -> Column:
    return F.shiftright(x, SHIFT)


def compatible(a: Column, b: Column, system: System) -> Column:
    """Whether some segment is allowed by both."""

    def cell(e: Column) -> Column:
        x, y, k = e["x"], e["y"], e["p"]["k"]
        p, q = _mask(x), _mask(y)
        common, single = p.bitwiseAND(q) != 0, lambda m: F.bit_count(m) == 1
        one_of = F.when(_has(x, ONE_OF) & _has(y, ONE_OF), common).when(_has(x, ONE_OF), single(q) & common).when(_has(y, ONE_OF), single(p) & common)
        labels = (_has(x, ANY) | (p != 0)) & (_has(y, ANY) | (q != 0)) & (_has(x, ANY) | _has(y, ANY) | one_of.otherwise(p == q))
        return (_has(x, NA) & _has(y, NA)) | F.when(k == GROUP, labels).otherwise(common)

    return F.forall(F.arrays_zip(a.alias("x"), b.alias("y"), _places(system, None).alias("p")), cell)


def distance(a: Column, b: Column, system: System, preset: str | None = None) -> Column:
    """The distance over the cells that both specify, 0 where there are none."""
    zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))

    def specified(x: Column, k: Column) -> Column:
        whole = F.when(k == GROUP, ~_has(x, ONE_OF)).otherwise(F.bit_count(_mask(x)) == 1)
        return ~_has(x, ANY) & F.when(_has(x, NA), _mask(x) == 0).otherwise(whole)

    def step(s: Column, e: Column) -> Column:
        x, y, p = e["x"], e["y"], e["p"]
        none_x, none_y = _has(x, NA), _has(y, NA)
        value = lambda z: F.when(_has(z, NA), 0.0).when(p["k"] == ORDINAL, F.log2(_mask(z).cast("double"))).otherwise(F.when(_mask(z) == B.PLUS, 1.0).when(_mask(z) == B.MINUS, -1.0).otherwise(0.0))
        spoken = F.when(p["k"] == ORDINAL, ~none_x & ~none_y).when(p["k"] == VALUED, ~none_x & ~none_y & ((value(x) != 0) | (value(y) != 0))).otherwise(~none_x | ~none_y)
        apart = F.when(p["k"] == GROUP, (x != y).cast("double")).otherwise(F.abs(value(x) - value(y)) / p["d"])
        use = specified(x, p["k"]) & specified(y, p["k"]) & spoken
        return F.when(use, F.struct((s["num"] + p["w"] * apart).alias("num"), (s["den"] + p["w"]).alias("den"))).otherwise(s)

    paired = F.arrays_zip(a.alias("x"), b.alias("y"), _places(system, preset).alias("p"))
    return F.aggregate(paired, zero, step, lambda s: F.when(s["den"] > 0, s["num"] / s["den"]).otherwise(0.0))
