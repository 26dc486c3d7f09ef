"""Results as JSON lines, JSON payloads and escaped TSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonospark.functions.strings import tsv_escape


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def payload(status: Column, value: Column) -> Column:
    """{"ok": true, "value": ...} or {"ok": false, "error": status}; for numbers see `number_payload`."""
    good = F.to_json(F.struct(F.lit(True).alias("ok"), value.alias("value")))
    return F.when(status == "ok", good).otherwise(_refused(status))


def _refused(status: Column) -> Column:
    return F.to_json(F.struct(F.lit(False).alias("ok"), status.alias("error")))


def finite(c: Column) -> Column:
    """A number, null where it isn't finite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def short_number(c: Column) -> Column:
    """A finite double in six significant digits without zeros at the end, as C's %.6g writes it; null for others.

    Below 10^-4 and from 10^6 on it has an exponent of two digits or more. A tie of the shortest decimal form is rounded up.
    """
    text = F.format_string("%.5e", F.abs(finite(c)))
    digits, power = F.regexp_replace(F.substring_index(text, "e", 1), r"\.", ""), F.substring_index(text, "e", -1).cast("int")
    bare = lambda x: F.regexp_replace(x, r"\.?0+$", "")
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0))), digits)
    above = F.concat(F.left(digits, power + 1), F.lit("."), F.substr(digits, power + 2, F.lit(6)), F.lit("0"))
    small, large = (power < -4), (power > 5)
    exponent = F.concat(bare(F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))), F.lit("e"), F.when(small, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    sign = F.when((c < 0) | ((c == 0) & F.startswith(c.cast("string"), F.lit("-"))), "-").otherwise("")
    body = F.when(finite(c) == 0, "0").when(small | large, exponent).when(power < 0, bare(below)).otherwise(bare(above))
    return F.when(finite(c).isNotNull(), F.concat(sign, body))


def number_payload(status: Column, value: Column) -> Column:
    """The same for a double, in six digits; a number that isn't finite is null."""
    good = F.concat(F.lit('{"ok":true,"value":'), F.coalesce(short_number(value), F.lit("null")), F.lit("}"))
    return F.when(status == "ok", good).otherwise(_refused(status))


def as_tsv(df: DataFrame) -> DataFrame:
    cells = (F.coalesce(tsv_escape(F.col(c).cast("string")), F.lit("")) for c in df.columns)
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def write_text(df: DataFrame, path: str, kind: str = "jsonl") -> None:
    (as_tsv(df) if kind == "tsv" else as_json(df)).write.mode("overwrite").text(path)
