"""Bundles in columns: from graphemes or text, compared, and searched in an inventory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonospark.functions import bundles as B
from phonospark.functions import masks as M
from phonospark.functions.geometry import DEFAULT_SYSTEM
from phonospark.operators.resolve import resolve_types
from phonospark.sources.catalog import Catalog

COMPARISON = "distance double, coverage double, comparability string, minimum double, maximum double"


def from_graphemes(df: DataFrame, column: str, catalog: Catalog, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """df with bundle_status and bundle (canonical text); tones and clusters are unsupported."""
    s = catalog.system(system)
    types = resolve_types(df.select(F.col(column).alias("token")), catalog, system)

    @F.pandas_udf(T.StringType())
    def written(features: pd.Series) -> pd.Series:
        cols = B.columns(s)
        return features.map(lambda f: None if f is None else B.text(s, tuple(B.of_features(c, f) for c in cols)))

    plain = (F.size("r.components") == 0) & ~F.array_contains("r.features", "tonal-autosegment")
    status = F.when((F.col("status") == "ok") & ~plain, "unsupported-model").otherwise(F.col("status"))
    made = types.withColumn("bundle_status", status).withColumn("bundle", written(F.when(F.col("bundle_status") == "ok", F.col("r.features"))))
    return df.join(made.select(F.col("token").alias("_t"), "bundle_status", "bundle"), F.col(column) == F.col("_t"), "left").drop("_t")


def canonical(df: DataFrame, column: str, catalog: Catalog, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """df with status and the canonical text of a column of bundle texts."""
    s = catalog.system(system)

    @F.pandas_udf("status string, text string")
    def read(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append(("ok", B.text(s, B.parse(s, t or ""))))
            except B.BadCell:
                out.append(("parse-error", None))
            except KeyError:
                out.append(("unknown-feature", None))
        return pd.DataFrame(out, columns=["status", "text"])

    return df.withColumn("canonical", read(F.col(column)))


def compare(df: DataFrame, a: str, b: str, catalog: Catalog, system: str = DEFAULT_SYSTEM, preset: str | None = None) -> DataFrame:
    """df with comparison struct(distance, coverage, comparability, minimum, maximum) and compatible."""
    s = catalog.system(system)

    @F.pandas_udf(f"{COMPARISON}, compatible boolean")
    def both(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        cells = {t: B.parse(s, t) for t in {*x.dropna(), *y.dropna()}}
        out = [{**B.compare(s, cells[p], cells[q], preset), "compatible": B.compatible(s, cells[p], cells[q])} if p is not None and q is not None else {} for p, q in zip(x, y)]
        return pd.DataFrame(out, columns=["distance", "coverage", "comparability", "minimum", "maximum", "compatible"])

    return df.withColumn("comparison", both(F.col(a), F.col(b)))


def compatible_graphemes(bundles: DataFrame, column: str, catalog: Catalog, system: str = DEFAULT_SYSTEM, preset: str | None = None) -> DataFrame:
    """(all columns, grapheme, distance, rank): listed graphemes that a bundle allows, nearest first, then by bytes.

    Bundles repeat, so distinct texts are compiled once and held against the inventory, a broadcast of
    some hundred compiled rows, by expressions on their masks; what is found is joined back.
    """
    s = catalog.system(system)
    listed = catalog.inventory(bundles.sparkSession, system).where(~F.array_contains("features", "tonal-autosegment")).select("grapheme", M.of_features(F.col("features"), s).alias("_own"))
    texts = bundles.select(F.col(column).alias("_text")).where(F.col("_text").isNotNull()).distinct().select("_text", M.of_text(F.col("_text"), s).alias("_cells"))
    fits = texts.join(F.broadcast(listed), M.compatible(F.col("_cells"), F.col("_own"), s)).select("_text", "grapheme", M.distance(F.col("_cells"), F.col("_own"), s, preset).alias("distance"))
    found = fits.groupBy("_text").agg(F.array_sort(F.collect_list(F.struct("distance", "grapheme"))).alias("_found"))
    rows = bundles.join(found, F.col(column) == F.col("_text")).select(*(F.col(f"`{c}`") for c in bundles.columns), F.posexplode("_found").alias("_at", "_one"))
    return rows.select(*(F.col(f"`{c}`") for c in bundles.columns), "_one.grapheme", "_one.distance", (F.col("_at") + 1).alias("rank"))


def covering(df: DataFrame, by: str, column: str, catalog: Catalog, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """(by, bundle): the least bundle over each group's distinct bundles, merged pairwise in the partial step.

    Every task first merges what it has of a group, so one row a group and task is moved.
    """
    s = catalog.system(system)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            for key, t in zip(frame[by], frame[column]):
                cells = B.parse(s, t)
                held[key] = B.covering(s, [held[key], cells]) if key in held else cells
        yield pd.DataFrame([(k, B.text(s, v)) for k, v in held.items()], columns=[by, column])

    schema = T.StructType([df.schema[by], T.StructField(column, T.StringType())])
    part = df.select(by, column).where(F.col(column).isNotNull()).distinct().mapInPandas(merge, schema)
    return part.repartition(by).mapInPandas(merge, schema)
