"""The same resolution and scoring on streams: both are stateless, so a batch of a stream is a table.

An extension: the operators themselves know no time. Counts of tokens by status over windows of event
time show how late rows and state are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonospark.functions import strings as S
from phonospark.functions.geometry import DEFAULT_SYSTEM
from phonospark.operators.resolve import by_grammar
from phonospark.sources.catalog import Catalog


def resolved_stream(stream: DataFrame, column: str, catalog: Catalog, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """(token, status, r) for each token of a column of transcriptions, as rows arrive."""
    tokens = stream.select(F.explode(S.segment_ipa(F.col(column))).alias("token"))
    return by_grammar(tokens, catalog, system).drop("system")


def windowed_counts(stream: DataFrame, column: str, time: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, token, n) over event time; rows later than `late` are dropped with their state."""
    tokens = stream.withWatermark(time, late).select(time, F.explode(S.segment_ascii(F.col(column))).alias("token"))
    return tokens.groupBy(F.window(time, width), "token").agg(F.count("*").alias("n"))
