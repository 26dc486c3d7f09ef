"""Functions for Spark SQL: on single values, and tables of rows for lateral joins.

Whole columns are better served by `phonospark.operators`, which resolve distinct tokens once; these are for
queries that are written as SQL. They run in Arrow batches and remember a batch's tokens; table functions
keep their automaton for a whole partition.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from phonospark.functions import bundles as B
from phonospark.functions import strings as S
from phonospark.functions import resolver as R
from phonospark.functions.automaton import Prefixes, Segmenter, orthographic
from phonospark.functions.geometry import DEFAULT_SYSTEM
from phonospark.sources.catalog import Catalog


def register(spark: SparkSession, catalog: Catalog, system: str = DEFAULT_SYSTEM, prefix: str = "phono_") -> list[str]:
    """Register the functions under their names with a prefix; gives the names. A null argument gives null.

    status(token), is_segment(token), features(token), path(token), diagnose(token), normalize(token),
    bundle(token), bundle_distance(bundle, bundle), list_systems().
    """
    s, inventory = catalog.system(system), catalog.inventories[system]

    def each(f: Callable, kind: str):
        @F.pandas_udf(kind)
        def run(tokens: pd.Series) -> pd.Series:
            resolve, held = R.Resolver(s, inventory), {}
            for t in tokens.dropna().unique():
                held[t] = f(resolve, t)
            return tokens.map(lambda t: None if t is None else held[t])

        return run

    def bundle(resolve: R.Resolver, token: str) -> str | None:
        got = resolve(token)
        plain = isinstance(got, R.Resolution) and not got.components and not R.is_tone(got.features)
        return B.text(s, tuple(B.of_features(c, got.features) for c in B.columns(s))) if plain else None

    @F.pandas_udf("double")
    def bundle_distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else B.compare(s, B.parse(s, x), B.parse(s, y))["distance"] for x, y in zip(a, b)], dtype=float)

    names = catalog.names()

    @F.udf("array<string>")
    def list_systems() -> list[str]:
        return names

    of = lambda got, name: getattr(got, name) if isinstance(got, R.Resolution) else None
    found = {
        "status": each(lambda r, t: r.status(t), "string"),
        "is_segment": each(lambda r, t: {R.OK: True, R.UNSUPPORTED: None}.get(r.status(t), False), "boolean"),
        "features": each(lambda r, t: list(of(r(t), "features") or []) or None, "array<string>"),
        "path": each(lambda r, t: of(r(t), "path"), "string"),
        "diagnose": each(lambda r, t: "|".join(map(str, Prefixes(r).diagnose(t))), "string"),
        "normalize": each(lambda r, t: R.normalize_grapheme(t), "string"),
        "bundle": each(bundle, "string"),
        "bundle_distance": bundle_distance,
        "list_systems": list_systems,
    }
    for name, f in found.items():
        spark.udf.register(prefix + name, f)
    return [prefix + n for n in found]


def register_tables(spark: SparkSession, catalog: Catalog, system: str = DEFAULT_SYSTEM, prefix: str = "phono_") -> list[str]:
    """Register table functions under their names with a prefix; gives the names. A null argument gives no row.

    tokens(text): (pos, token) as written; merged_tokens(text): with tones on their syllables;
    segments(text): joined into the longest listed segments; diagnosis(token): (status, valid_prefix_bytes,
    offending_offset, offending); inventory(): (grapheme, features) of the system. To be used with LATERAL.
    """
    s, inventory = catalog.system(system), catalog.inventories[system]
    numbered = "pos int, token string"

    class Tokens:
        def eval(self, text: str):
            yield from enumerate(orthographic(text) if text is not None else ())

    class Merged:
        def eval(self, text: str):
            yield from enumerate(S.merged(orthographic(text)) if text is not None else ())

    class Segments:
        def __init__(self):
            self.read = Segmenter(R.Resolver(s, inventory))

        def eval(self, text: str):
            yield from enumerate(self.read(orthographic(text)) if text is not None else ())

    class Diagnosis:
        def __init__(self):
            self.read = Prefixes(R.Resolver(s, inventory))

        def eval(self, token: str):
            if token is not None:
                yield self.read.diagnose(token)

    class Inventory:
        def eval(self):
            yield from ((g, list(f)) for g, f in inventory.items())

    found = {
        "tokens": (Tokens, numbered),
        "merged_tokens": (Merged, numbered),
        "segments": (Segments, numbered),
        "diagnosis": (Diagnosis, "status string, valid_prefix_bytes int, offending_offset int, offending string"),
        "inventory": (Inventory, "grapheme string, features array<string>"),
    }
    for name, (of, kind) in found.items():
        spark.udtf.register(prefix + name, F.udtf(of, returnType=kind, useArrow=True))
    return [prefix + n for n in found]
