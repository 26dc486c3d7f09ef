"""Resolution at scale: distinct tokens once, each through the grammar in one pass.

Tokens repeat, so a column of tokens is reduced to its distinct values first (a partial aggregate, then one
shuffle of types). Types go through the grammar in Arrow batches, under all systems that are asked for at
once; inventories are tables of some thousand rows and are sent with the code. Texts are segmented and
diagnosed by automata that each worker builds as its texts ask for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonospark.functions.automaton import Prefixes, Segmenter, orthographic
from phonospark.functions.geometry import DEFAULT_SYSTEM
from phonospark.functions.resolver import OK, Resolution, Resolver
from phonospark.sources.catalog import Catalog

RESOLUTION = "struct<path:string,grapheme:string,features:array<string>,components:array<struct<grapheme:string,features:array<string>>>>"
RESOLVED = f"system string, token string, status string, r {RESOLUTION}"
_ARROW = pa.struct([("path", pa.string()), ("grapheme", pa.string()), ("features", pa.list_(pa.string())), ("components", pa.list_(pa.struct([("grapheme", pa.string()), ("features", pa.list_(pa.string()))])))])


def _sent(df: DataFrame, catalog: Catalog, *systems: str):
    """The systems and their inventories, a broadcast of some thousand rows."""
    return df.sparkSession.sparkContext.broadcast([(catalog.system(s), catalog.inventories[s]) for s in systems])


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as shuffles have: what Python does with distinct tokens costs far more than their few bytes say."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def by_grammar(tokens: DataFrame, catalog: Catalog, *systems: str) -> DataFrame:
    """(system, token, status, r) of a column of tokens, each through the grammar of each system (the default one if none)."""
    systems = systems or (DEFAULT_SYSTEM,)
    sent = _sent(tokens, catalog, *systems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Resolver(*own) for own in sent.value]
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            for resolve in readers:
                status, out = [], []
                for token in tokens:
                    got = resolve(token)
                    good = isinstance(got, Resolution)
                    status.append(OK if good else got)
                    out.append({"path": got.path, "grapheme": got.grapheme, "features": list(got.features), "components": [{"grapheme": g, "features": list(f)} for g, f in got.components]} if good else None)
                name = pa.array([resolve.system.name] * len(tokens), pa.string())
                yield pa.RecordBatch.from_arrays([name, batch.column(0), pa.array(status, pa.string()), pa.array(out, _ARROW)], names=["system", "token", "status", "r"])

    return tokens.select("token").mapInArrow(run, RESOLVED)


def resolve_types(tokens: DataFrame, catalog: Catalog, *systems: str) -> DataFrame:
    """(token, status, r) of the distinct tokens of a column `token`; null tokens are left out.

    With several systems, one row for each and a column `system`; the tokens are reduced and read once.
    """
    types = tokens.select("token").where(F.col("token").isNotNull()).distinct()
    out = by_grammar(types, catalog, *systems)
    return out if len(systems) > 1 else out.drop("system")


def with_types(df: DataFrame, column: str, types: DataFrame) -> DataFrame:
    """df joined with types (_token and more, one row a token) on a column that a few frequent tokens may fill.

    No job runs here: adaptive execution broadcasts types where their size, known by then, allows it, and
    splits the partitions of frequent tokens where not.
    """
    return df.join(types, F.col(column) == F.col("_token"), "left").drop("_token")


def resolve(df: DataFrame, column: str, catalog: Catalog, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """df with `status` and `r` for a column of tokens (null for a null token)."""
    types = resolve_types(df.select(F.col(column).alias("token")), catalog, system).withColumnRenamed("token", "_token")
    return with_types(df, column, types)


def is_segment(status: Column) -> Column:
    """True, false, or null where the system can't say."""
    return F.when(status == "ok", True).when(status == "unsupported-model", F.lit(None).cast("boolean")).otherwise(False)


DIAGNOSIS = "struct<status:string,valid_prefix_bytes:int,offending_offset:int,offending:string>"
_DIAGNOSIS = pa.struct([("status", pa.string()), ("valid_prefix_bytes", pa.int32()), ("offending_offset", pa.int32()), ("offending", pa.string())])


def diagnose(df: DataFrame, column: str, catalog: Catalog, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """df with diagnosis struct(status, valid_prefix_bytes, offending_offset, offending).

    Distinct tokens are read once from left to right; the last place where what was read resolves is the
    longest valid prefix.
    """
    types = spread(df.select(F.col(column).alias("token")).where(F.col(column).isNotNull()).distinct())
    sent = _sent(df, catalog, system)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Prefixes(Resolver(*sent.value[0]))
        for batch in batches:
            told = [dict(zip(_DIAGNOSIS.names, read.diagnose(t))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, _DIAGNOSIS)], names=["_token", "diagnosis"])

    return with_types(df, column, types.mapInArrow(run, f"_token string, diagnosis {DIAGNOSIS}"))


def _segmented(df: DataFrame, source: Column, catalog: Catalog, system: str, tokens) -> DataFrame:
    sent, held = _sent(df, catalog, system), []

    @F.arrow_udf("array<string>")
    def segments(values: pa.Array) -> pa.Array:
        if not held:
            held.append(Segmenter(Resolver(*sent.value[0])))
        return pa.array([None if x is None else held[0](tokens(x)) for x in values.to_pylist()], pa.list_(pa.string()))

    # else the optimizer would run it once more for each filter that it infers from an explode
    return df.withColumn("segments", segments.asNondeterministic()(source))


def system_segment(df: DataFrame, tokens: str, catalog: Catalog, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """df with `segments`: orthographic tokens joined, left to right, into the longest listed segments.

    Rows stay where they are: an automaton over the listed spellings reads each row's tokens once.
    """
    return _segmented(df, F.col(tokens), catalog, system, list)


def system_segment_text(df: DataFrame, text: str, catalog: Catalog, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """The same for a column of texts, which are cut into orthographic tokens on the way."""
    return _segmented(df, F.col(text), catalog, system, orthographic)


def recognized(df: DataFrame, tokens: str, catalog: Catalog, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """(all columns, pos, token, recognized) a row for each token of an array column."""
    each = df.select("*", F.posexplode(tokens).alias("pos", "token"))
    return resolve(each, "token", catalog, system).withColumn("recognized", is_segment(F.col("status"))).drop("status", "r")
