"""What several operators share: cutting lineage, connected components, document columns."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters, the only ones that the contracts lower-case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Take the cluster's folder; set one of our own only where none is named and all runs on one machine."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", "") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="phonospark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df into the shared checkpoint folder and go on from those files."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of one key from which it is joined apart, and the most such keys that are broadcast.
HOT_ROWS, HOT_KEYS = 5_000, 1_000_000


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], weight: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """big joined with small (one row a key, with `weight`, big's rows of that key), hot keys without a shuffle.

    Keys of more than hot_rows rows are few (at most big's rows / hot_rows) and are broadcast if they are
    HOT_KEYS at most; all others, and all where there are more, meet by a shuffle.
    """
    hot = small.where(F.col(weight) > hot_rows)
    n = hot.count()
    if not n or n > HOT_KEYS:
        return big.join(small, keys, how)
    cold = small.where(F.col(weight) <= hot_rows)
    own = big.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys, how)
    return own.unionByName(big.join(F.broadcast(hot), keys, "left_semi" if how == "left_semi" else "inner"))


#: Tasks that the rows of a hot key are dealt to.
DEALS = 32


def semi_join_hot(big: DataFrame, small: DataFrame, key: str, weight: str, spread: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """big's rows whose key is in small (one row a key, with `weight`), read once, hot keys dealt to many tasks.

    Hot keys are marked by a broadcast of those few; their rows get a part by a hash of `spread` and of the
    task that made them, and small has such a key in every part. Where they are too many to broadcast, a
    plain join, whose skewed partitions adaptive execution splits.
    """
    hot = small.where(F.col(weight) > hot_rows).select(key)
    n = hot.count()
    if not n or n > HOT_KEYS:
        return big.join(small.select(key), key, "left_semi")
    marked = big.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread, F.spark_partition_id()), F.lit(DEALS))).otherwise(0)
    parts = F.when(F.col(weight) > hot_rows, F.sequence(F.lit(0), F.lit(DEALS - 1))).otherwise(F.array(F.lit(0)))
    of = small.select(key, F.explode(parts.cast("array<bigint>")).alias("_part"))
    return marked.withColumn("_part", part.cast("long")).join(of, [key, "_part"], "left_semi").drop("_hot", "_part")


def row_key(columns: list[str], salt: int) -> Column:
    """A hash of a whole row; nulls count by their place."""
    quoted = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(F.lit(salt), *quoted, *(c.isNull() for c in quoted))


def text_bytes(column: str = "text"):
    """Whole text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Each batch in small slices, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield part, [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(a long, b long) links -> (node, component), component being the smallest node reachable.

    Alternating stars: every round points a node's larger, then its smaller neighbours at the
    smallest one. Minima are aggregated before they are joined back, so a node with very many
    links is split like any skewed join. No links give an empty result.
    """
    a, b = F.col("a"), F.col("b")
    cur = cut(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    last = None
    for _ in range(rounds):
        both = cur.union(cur.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        cur = cut(small.select(b.alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where(a != b).distinct())
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # settled: a node's single link is to the smallest node of its component
    nodes = cur.select(a.alias("node"), b.alias("component"))
    return nodes.union(cur.select(b.alias("node"), b.alias("component")).distinct())
