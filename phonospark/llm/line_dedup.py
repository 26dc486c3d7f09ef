"""Reversible line deduplication: sharded cuckoo filters in front of exact reference tables.

A line's key is 128 bits of its stripped, lower-cased bytes. The exact tables hold one reference
(key, doc_id) for each document that has the key, as a log of additions and removals, and the count of
every *repeated* key, one with enough references. Repeated keys also stand in cuckoo filters, one for
each shard of the key space. Inserting documents adds references, deleting them takes the same references
away; only keys of the change are counted anew, and the filters of their shards follow: a key goes in
when it becomes repeated and comes out again when it no longer is (which a Bloom filter could not do).

To apply the state, documents' lines are tried against the filters, and only lines that hit are checked
against the exact table. Filters whose total size is under a limit are sent to where the documents lie;
larger ones meet the lines' keys in their shards. Both ways give the same hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonospark.llm.common import cut, join_hot, rows_of, text_bytes

SPACE = b" \t\n\v\f\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: Keys that a filter shard is laid out for, and the most bytes of filters that are broadcast.
SHARD_KEYS, BROADCAST_BYTES = 200_000, 64 << 20
#: Tasks that a shard's keys are dealt to by document, so that no key's documents all meet in one.
DEALS = 8
SLOTS = 4
KEY = ["hi", "lo"]


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """16 bytes, or None where the key has fewer than min_chars code points."""
    k = line.strip(SPACE).lower()
    if len(k) < min_chars or len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(k)


class CuckooFilter:
    """Four 16-bit marks in a bucket; a mark may stand in either of two buckets.

    Deleting removes one copy of a mark, so only keys that were inserted may be deleted. A filter that
    is too full grows: the caller builds it anew from the exact table (insert returns False).
    """

    def __init__(self, buckets: int, data: bytes | None = None) -> None:
        self.n = buckets
        self.t = np.zeros(buckets * SLOTS, np.uint16) if data is None else np.frombuffer(data, np.uint16).copy()

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, int(keys / SLOTS / 0.8).bit_length()))

    def to_bytes(self) -> bytes:
        return self.t.tobytes()

    def _places(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (lo & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (lo >> np.uint64(16)).astype(np.int64) & (self.n - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket, mark):
        return bucket ^ (np.asarray(mark).astype(np.int64) * 0x5BD1E995 >> 7) & (self.n - 1)

    def contains(self, lo: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(lo)
        t = self.t.reshape(-1, SLOTS)
        return (t[one] == mark[:, None]).any(1) | (t[two] == mark[:, None]).any(1)

    def insert(self, lo: np.ndarray) -> bool:
        rng = np.random.default_rng(7)
        for mark, one, two in zip(*(x.tolist() for x in self._places(lo))):
            at = one
            for _ in range(500):
                row = self.t[at * SLOTS : at * SLOTS + SLOTS]
                if not row.all():
                    row[int(np.argmin(row != 0))] = mark
                    break
                other = self.t[two * SLOTS : two * SLOTS + SLOTS]
                if at == one and not other.all():
                    other[int(np.argmin(other != 0))] = mark
                    break
                k = int(rng.integers(SLOTS))
                mark, row[k] = int(row[k]), mark
                at = int(self._other(at, mark))
                one = -1
            else:
                return False
        return True

    def delete(self, lo: np.ndarray) -> None:
        for mark, one, two in zip(*(x.tolist() for x in self._places(lo))):
            for at in (one, two):
                row = self.t[at * SLOTS : at * SLOTS + SLOTS]
                hit = np.flatnonzero(row == mark)
                if len(hit):
                    row[hit[0]] = 0
                    break


def references(docs: DataFrame, min_chars: int = MIN_CHARS, filters: dict[int, bytes] | None = None, shards: int = 1) -> DataFrame:
    """(hi, lo, doc_id): each row's distinct keys; with filters, only keys that hit one."""
    sent = None if filters is None else docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: CuckooFilter(len(v) // 2 // SLOTS, v) for k, v in sent.value.items()} if sent else None
        for _, (doc_ids, texts) in rows_of(batches, "doc_id", "text"):
            owners, keys = [], []
            for doc_id, text in zip(doc_ids, texts):
                own = {k for line in text.split(b"\n") if (k := key_of(line, min_chars))}
                keys += own
                owners += [doc_id] * len(own)
            k = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2)
            ids = pa.array(owners, pa.int64())
            if held is not None:
                use, shard = np.zeros(len(k), bool), (k[:, 0] % np.uint64(shards)).astype(np.int64)
                for s, f in held.items():
                    at = np.flatnonzero(shard == s)
                    use[at] = f.contains(k[at, 1])
                k, ids = k[use], ids.filter(pa.array(use))
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0].view(np.int64)), pa.array(k[:, 1].view(np.int64)), ids], names=["hi", "lo", "doc_id"])

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, "hi long, lo long, doc_id long")


def in_shards(refs: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The references that hit their shard's filter, wherever filters are too large to be sent around.

    A shard's filter goes before its keys in each of the tasks that they are dealt to, so a task holds
    one filter and one batch of keys.
    """
    deal = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(DEALS))
    keys = refs.select(shard_of(shards).alias("shard"), deal.alias("deal"), F.lit(None).cast("binary").alias("filter"), "hi", "lo", "doc_id")
    none = F.lit(None).cast("long")
    heads = filters.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))).alias("deal"), "filter", none.alias("hi"), none.alias("lo"), none.alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None
        for batch in batches:
            table = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            of = table["shard"].to_numpy()
            heads = np.flatnonzero(table["filter"].is_valid().to_numpy(zero_copy_only=False))
            use = np.zeros(len(of), bool)
            for a, b in zip([0, *heads.tolist()], [*heads.tolist(), len(of)]):
                if table["filter"][a].is_valid if a < len(of) else False:
                    data = table["filter"][a].as_py()
                    shard, held, a = of[a], CuckooFilter(len(data) // 2 // SLOTS, data), a + 1
                own = np.arange(a, b)[of[a:b] == shard] if held is not None else np.zeros(0, np.int64)
                if len(own):
                    use[own] = held.contains(table["lo"].take(pa.array(own)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([table[c] for c in ("hi", "lo", "doc_id")], names=["hi", "lo", "doc_id"]).filter(pa.array(use))

    dealt = heads.unionByName(keys).repartition("shard", "deal").sortWithinPartitions("shard", "deal", F.col("filter").isNull())
    return dealt.mapInArrow(run, "hi long, lo long, doc_id long")


def counted(refs: DataFrame) -> DataFrame:
    """(hi, lo, n, top): the documents of each key, and the largest doc_id. Rows without an id are one document."""
    return refs.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))


def repeated(refs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The counted keys of at least min_docs documents."""
    return counted(refs).where(F.col("n") >= min_docs)


def shard_of(shards: int):
    """The shard of a key: its high half, unsigned, modulo the number of shards."""
    half = F.pmod(F.shiftrightunsigned("hi", 1), F.lit(shards))
    return F.pmod(half * 2 + F.expr("hi & 1"), F.lit(shards)).cast("long")


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, filter): a cuckoo filter for each shard that has keys."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, room = pdf["lo"].to_numpy().view(np.uint64), len(pdf)
        while not (f := CuckooFilter.sized(room)).insert(lo):
            room *= 2
        return pd.DataFrame({"shard": [key[0]], "filter": [f.to_bytes()]})

    return keys.select(shard_of(shards).alias("shard"), "lo").groupBy("shard").applyInPandas(build, "shard long, filter binary")


class LineDedup:
    """State over many inserts and deletes.

    log: (hi, lo, doc_id, d), references that were added (d = 1) and removed (d = -1), in layers that are
    never rewritten. keys: (hi, lo, n, top) of repeated keys. filters: (shard, filter). A change reads the
    log through a semi-join with its own keys and counts only those; filters of other shards stay.
    """

    def __init__(self, log: DataFrame, keys: DataFrame, filters: DataFrame, shards: int, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> None:
        self.log, self.keys, self.filters, self.shards, self.min_chars, self.min_docs = log, keys, filters, shards, min_chars, min_docs

    @classmethod
    def empty(cls, spark, shards: int = 64, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineDedup:
        frame = lambda schema: spark.createDataFrame([], schema)
        return cls(frame("hi long, lo long, doc_id long, d int"), frame("hi long, lo long, n long, top long"), frame("shard long, filter binary"), shards, min_chars, min_docs)

    @staticmethod
    def standing(log: DataFrame) -> DataFrame:
        """References that were added and not removed since."""
        return log.groupBy(*KEY, "doc_id").agg(F.sum("d").alias("d")).where("d > 0").drop("d")

    def _moved(self, change: DataFrame) -> LineDedup:
        """change: (hi, lo, doc_id, d), cut; additions are new and removals are of standing references."""
        touched = cut(change.select(*KEY).distinct())
        log = self.log.unionByName(change)
        now = cut(counted(self.standing(log.join(touched, KEY, "left_semi"))).where(F.col("n") >= self.min_docs))
        was = self.keys.join(touched, KEY, "left_semi").select(*KEY)
        come, gone = now.select(*KEY).join(was, KEY, "left_anti"), was.join(now.select(*KEY), KEY, "left_anti")
        moves = cut(come.withColumn("add", F.lit(True)).union(gone.withColumn("add", F.lit(False))).withColumn("shard", shard_of(self.shards)))
        keys = cut(self.keys.join(touched, KEY, "left_anti").unionByName(now))

        def follow(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            add = new["lo"].to_numpy(np.int64).view(np.uint64)[new["add"].to_numpy(bool)]
            sub = new["lo"].to_numpy(np.int64).view(np.uint64)[~new["add"].to_numpy(bool)]
            data = old["filter"].iloc[0] if len(old) else None
            f = CuckooFilter(len(data) // 2 // SLOTS, data) if data is not None else CuckooFilter.sized(max(len(add), 1024))
            f.delete(sub)
            ok = f.insert(add)
            return pd.DataFrame({"shard": [key[0]], "filter": [f.to_bytes() if ok else None]})

        shards = F.broadcast(moves.select("shard").distinct())  # at most self.shards rows
        followed = cut(self.filters.join(shards, "shard", "left_semi").groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(follow, "shard long, filter binary"))
        full = followed.where(F.col("filter").isNull()).select("shard")
        again = build_filters(keys.withColumn("shard", shard_of(self.shards)).join(full, "shard", "left_semi"), self.shards)
        filters = self.filters.join(shards, "shard", "left_anti").unionByName(followed.where(F.col("filter").isNotNull())).unionByName(again)
        return LineDedup(log, keys, cut(filters), self.shards, self.min_chars, self.min_docs)

    def insert(self, docs: DataFrame) -> LineDedup:
        """Documents that are there already, with the same lines, change nothing."""
        new = cut(references(docs, self.min_chars).distinct())
        held = self.standing(self.log.join(new.select(*KEY).distinct(), KEY, "left_semi"))
        same = (new["hi"] == held["hi"]) & (new["lo"] == held["lo"]) & new["doc_id"].eqNullSafe(held["doc_id"])
        return self._moved(cut(new.join(held, same, "left_anti").withColumn("d", F.lit(1))))

    def delete(self, doc_ids: DataFrame) -> LineDedup:
        """All references of these documents go, those of a null id as well if it is among them."""
        ids = doc_ids.select(F.col("doc_id").alias("_id")).distinct()
        gone = self.log.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        return self._moved(cut(self.standing(gone).withColumn("d", F.lit(-1))))

    def apply(self, docs: DataFrame) -> DataFrame:
        return drop_lines(docs, self.keys, self.filters, self.shards, self.min_chars)


def drop_lines(docs: DataFrame, keys: DataFrame, filters: DataFrame, shards: int, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs' columns with the kept text, then n_lines and n_dropped unless docs has columns of those names."""
    size = filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size <= broadcast_bytes:
        hits = references(docs, min_chars, {r["shard"]: bytes(r["filter"]) for r in filters.collect()}, shards)
    else:
        hits = in_shards(references(docs, min_chars), filters, shards)
    lost = join_hot(hits, keys, KEY, "n").where((F.col("doc_id") < F.col("top")) | F.col("doc_id").isNull() & F.col("n").isNotNull())
    by_doc = lost.groupBy("doc_id").agg(F.collect_set(F.concat(F.unhex(F.lpad(F.hex("hi"), 16, "0")), F.unhex(F.lpad(F.hex("lo"), 16, "0")))).alias("lost"))
    by_doc = by_doc.select(F.struct(F.col("doc_id").alias("id"), "lost").alias("own"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_bytes().alias("text"))
    joined = whole.join(by_doc, F.col("id").eqNullSafe(F.col("own.id")), "left").select("row", "text", F.col("own.lost").alias("lost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (texts, keys) in rows_of(batches, "text", "lost"):
            kept, lines, dropped = [], [], []
            for text, gone in zip(texts, keys):
                own = text.split(b"\n")
                left = own if not gone else [x for x in own if key_of(x, min_chars) not in gone]
                kept.append((text if len(left) == len(own) else b"\n".join(left)).decode("utf-8", "replace"))
                lines.append(len(own))
                dropped.append(len(own) - len(left))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["row", "text", "n_lines", "n_dropped"])

    rest = [c for c in docs.columns if c != "text"]
    row = T.StructType([docs.schema[c] for c in rest])
    joined = joined.select(F.struct(*(F.col(f"row.`{c}`") for c in rest)).alias("row"), "text", "lost")
    schema = T.StructType([T.StructField("row", row), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out = joined.mapInArrow(run, schema)
    more = [c for c in ("n_lines", "n_dropped") if c not in rest]
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns), *more)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All of docs inserted into an empty state, and applied to them.

    Lines are split at newlines; a null or empty text is one empty line. A key found in min_docs or more
    documents loses all its lines but those of the largest doc_id that has it. Rows of one doc_id are one
    document, so such rows keep or lose a line together; rows without an id are one document, below all
    others, and a key held by min_docs documents is dropped from them. No rows give no rows. Very long
    texts and lines are read whole. docs' other columns stay as they are, whatever their names: where docs
    has n_lines or n_dropped itself, its own are kept and the counts are left out.
    """
    keys = cut(repeated(references(docs, min_chars), min_docs))
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    return drop_lines(docs, keys, cut(build_filters(keys, shards)), shards, min_chars)
