"""Tables of feature data, corpora and alignments as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonospark.functions import strings as S


#: Where a row stands: its file by name, the place of its split in the file, and its place in the split.
_PLACE = "struct(_metadata.file_path AS f, _metadata.file_block_start AS b, monotonically_increasing_id() AS i)"


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header, all columns strings, no quoting."""
    return spark.read.csv(path, sep="\t", header=True, quote="", escape="", encoding="UTF-8")


def read_categorical(spark: SparkSession, path: str) -> DataFrame:
    """(grapheme, features) of a GRAPHEME, FEATURES table; of equal keys the last row of the last file by name stays."""
    t = read_tsv(spark, path).select(S.literal_key(F.col("GRAPHEME")).alias("grapheme"), F.array_sort(F.array_distinct(F.split("FEATURES", r"\|"))).alias("features"), F.expr(_PLACE).alias("n"))
    return t.groupBy("grapheme").agg(F.max_by("features", "n").alias("features"))


def read_valued(spark: SparkSession, path: str) -> DataFrame:
    """(grapheme, features name=state); cells of equal keys that disagree become `?`."""
    t = read_tsv(spark, path).select(S.literal_key(F.col("GRAPHEME")).alias("grapheme"), F.explode(F.split("FEATURES", r"\|")).alias("cell"))
    cell = t.select("grapheme", F.regexp_extract("cell", r"^(.*)=([^=]*)$", 1).alias("name"), F.regexp_extract("cell", r"^(.*)=([^=]*)$", 2).alias("state"))
    one = cell.groupBy("grapheme", "name").agg(F.when(F.min("state") == F.max("state"), F.min("state")).otherwise("?").alias("state"))
    return one.groupBy("grapheme").agg(F.array_sort(F.collect_list(F.concat_ws("=", "name", "state"))).alias("features"))


def inventory_rows(df: DataFrame) -> dict[str, tuple[str, ...]]:
    """A dimension table as the catalog holds it. Inventories are small: some thousand rows."""
    return {r["grapheme"]: tuple(r["features"]) for r in df.select("grapheme", "features").collect()}


def rebuilt(rows: DataFrame, upstream: DataFrame) -> DataFrame:
    """rows (GRAPHEME and feature columns) with cells of upstream (Name and feature columns), by folded spelling.

    A row that upstream lacks, and a column that it lacks, keep their cells but for `.`, which is unknown.
    Upstream rows of one spelling: the last by Name counts.
    """
    fold = lambda c: F.translate(S.nfd(c), "ɡ", "g")
    features = [c for c in rows.columns if c != "GRAPHEME"]
    both = [c for c in features if c in upstream.columns]
    source = upstream.select(fold(F.col("Name")).alias("_key"), "Name", F.struct(F.lit(1).alias("_"), *(F.col(f"`{c}`") for c in both)).alias("_new"))
    source = source.groupBy("_key").agg(F.max_by("_new", "Name").alias("_new"))
    j = rows.withColumn("_key", fold(F.col("GRAPHEME"))).join(source, "_key", "left")

    def cell(c: str):
        own, new = F.col(f"`{c}`"), F.trim(F.col(f"_new.`{c}`")) if c in both else None
        kept = F.when(own == ".", "?").otherwise(own)
        return (kept if new is None else F.when(F.col("_new").isNull(), kept).when(new.isin("+", "-", "0"), new).otherwise("?")).alias(c)

    return j.select("GRAPHEME", *map(cell, features))


def rebuild_cells(df: DataFrame, name: str = "state") -> DataFrame:
    """Source cells as states: + - 0 stay, `N` is no value, contours and empty cells are unknown."""
    c = F.col(name)
    return df.withColumn(name, F.when(c.isin("+", "-", "0"), c).when(c == "N", "0").otherwise("?"))


def read_forms(spark: SparkSession, glob: str) -> DataFrame:
    """(dataset, form, segments) of word lists with a Segments column; boundary signs are dropped."""
    t = spark.read.csv(glob, header=True, multiLine=True, escape='"').withColumn("path", F.input_file_name())
    dataset = F.regexp_extract("path", r"([^/]+)/cldf/[^/]*$", 1)
    kept = F.filter(F.split(F.trim("Segments"), r"\s+"), lambda x: ~x.isin("+", "_", "#", ""))
    return t.where(F.length(F.trim("Segments")) > 0).select(dataset.alias("dataset"), F.col("ID").alias("form"), kept.alias("segments"))


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    """Languages by glottocode; of equal codes the last row stays."""
    t = read_tsv(spark, path).withColumn("n", F.expr(_PLACE))
    rest = [c for c in t.columns if c not in ("GLOTTOCODE", "n")]
    return t.groupBy("GLOTTOCODE").agg(*(F.max_by(c, "n").alias(c) for c in rest))


def read_inventories(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path).select(F.col("INVENTORY").alias("inventory"), F.col("GLOTTOCODE").alias("glottocode"), F.split(F.trim("SEGMENTS"), r"\s+").alias("segments"))


def read_alignments(spark: SparkSession, glob: str) -> DataFrame:
    """(file, row, name, cells) of alignment files: a title, a subtitle, then a name and its cells a line."""
    t = spark.read.text(glob, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("row", "line"))
    cells = F.split("line", "\t")
    marked = F.trim(cells[0]).rlike(r"^(?:LOCAL|SWAPS|MERGE|COMPLEX|CROSSED)") | F.col("line").rlike(r"^[@#:]")
    return t.where((F.col("row") >= 2) & (F.size(cells) > 1) & ~marked).select("file", "row", F.regexp_replace(cells[0], r"[. ]+$", "").alias("name"), F.filter(F.transform(F.slice(cells, 2, F.size(cells) - 1), lambda x: F.trim(x)), lambda x: x != "").alias("cells"))
