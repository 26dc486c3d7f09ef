"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits. Each is read as a word of the
perfect binary Golay code (23, 12, 7), in which every word lies within three bits of exactly one
codeword; that codeword's 12-bit index is the segment's key. Two words that differ in one bit may
decode to different codewords, so a probing segment takes the keys of all words within one bit of
it: one key, or six.

Pigeonhole: of three segments with at most three errors in all, two have at most one error each, and
unless it is one error in each of the three, one of those two has none. So the pair (1, 2) is probed
with all combinations of keys, the pairs (1, 3) and (2, 3) with those where one segment keeps its own
key. Every fingerprint lies in three buckets under its own keys and looks into about 47; the rows that
meet in a bucket are verified on all 64 bits.

Near duplicates at a similarity (`drop_near_duplicates`) differ in too many bits for that: at a Jaccard
index of 0.8, about one in seven. There a text has 943 bits of votes, cut into 41 segments of 23. Each is
decoded to the codeword nearest to its votes, weighing every bit by its majority, which two texts at 0.8
agree on with a probability of 0.26. Pairs of segments are the keys: of 82, such texts share one with a
probability of 0.99. Every link is verified on the exact sets of five-word shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonospark.llm.common import connected_components, cut, join_hot, row_key, rows_of, text_bytes

SEED, SHINGLE, MAX_BITS = 42, 3, 3
SEGMENTS = ((0, 21), (21, 21), (42, 22))
GOLAY_POLYNOMIAL = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
#: Near duplicates at a similarity: words of a shingle, the least Jaccard index as a fraction, 64-bit words of votes.
WORDS, LEAST, VOTES = 5, (4, 5), 15
PARTS = VOTES * 64 // 23
PAIRS = np.array([(i, (i + step) % PARTS) for step in (1, 2) for i in range(PARTS)])
#: Bits of the segments' that texts at the least index don't differ in but once in 500 (above it, hardly ever).
FAR = 176
#: Up to so many shingles their sets are compared at once: even sets tie at many bits, which then differ further.
SHORT = 64
#: The most bytes of sets that are sent around to verify links.
BROADCAST_BYTES = 16 << 20
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, VOTES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority vote over the bits of the shingles' XXH64; no words: zero; a tie leaves the bit 0."""
    words = text.lower().split()  # bytes: A-Z only, and exactly \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    hashed, seed = xxhash.xxh64_intdigest, SEED
    h = np.array([hashed(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (texts,) in rows_of(batches, "text"):
            fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, "doc_id long, fp long")


class Golay:
    """Decoding by syndrome: 2^11 remainders, one error pattern of at most three bits for each."""

    def __init__(self) -> None:
        one = []
        for bit in range(23):
            r = 1 << bit
            for k in range(22, 10, -1):
                if r >> k & 1:
                    r ^= GOLAY_POLYNOMIAL << (k - 11)
            one.append(r)
        self.tables = []
        for at in (0, 8, 16):
            t = np.zeros(256, np.int64)
            for v in range(256):
                for bit in range(8):
                    if v >> bit & 1 and at + bit < 23:
                        t[v] ^= one[at + bit]
            self.tables.append(t)
        self.error = np.zeros(2048, np.int64)
        bits = range(23)
        for e in [(), *((i,) for i in bits), *((i, j) for i in bits for j in range(i)), *((i, j, k) for i in bits for j in range(i) for k in range(j))]:
            r = w = 0
            for i in e:
                r, w = r ^ one[i], w | 1 << i
            self.error[r] = w

    def index(self, words: np.ndarray) -> np.ndarray:
        """12-bit index of the codeword within three bits of each 23-bit word."""
        s = self.tables[0][words & 255] ^ self.tables[1][words >> 8 & 255] ^ self.tables[2][words >> 16]
        return (words ^ self.error[s]) >> 11

    def near(self, words: np.ndarray, width: int) -> np.ndarray:
        """(n, width + 1) indices of all words within one bit; a repeat of the row is -1."""
        flips = np.concatenate(([0], 1 << np.arange(width)))
        keys = np.sort(self.index(words[:, None] ^ flips[None, :]), axis=1)
        keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
        return keys


def bucket_rows(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): key's lowest bit is 1 for the fingerprint's own bucket, 0 where it only looks."""
    u = fps.view(np.uint64)
    seg = [(u >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    own = [golay.index(s) for s in seg]
    near = [golay.near(s, width) for s, (_, width) in zip(seg, SEGMENTS)]
    keys, rows = [], []
    at = np.arange(len(fps))

    def add(pair: int, i: np.ndarray, j: np.ndarray, row: np.ndarray, base: int) -> None:
        good = (i >= 0) & (j >= 0)
        keys.append(((((pair << 12) | i[good]) << 12 | j[good]) << 1) | base)
        rows.append(row[good])

    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        add(pair, own[i], own[j], at, 1)
        if pair == 0:
            a, b = np.broadcast_arrays(near[i][:, :, None], near[j][:, None, :])
            add(pair, a.ravel(), b.ravel(), np.repeat(at, a[0].size), 0)
        else:
            for a, b in ((own[i][:, None], near[j]), (near[i], own[j][:, None])):
                a, b = np.broadcast_arrays(a, b)
                add(pair, a.ravel(), b.ravel(), np.repeat(at, a.shape[1]), 0)
    return np.concatenate(keys), np.concatenate(rows)


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join whatever is connected within the bucket: breadth first, against the rest only."""
    rest, out = fps, []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            block, front = front[:256], front[256:]
            close = np.bitwise_count(block[:, None] ^ rest[None, :]) <= max_bits
            hit = close.any(0)
            if hit.any():
                out.append((block[close.argmax(0)[hit]], rest[hit]))
                front = np.concatenate((front, rest[hit]))
                rest = rest[~hit]
    return out


def bucket_links(k: np.ndarray, fp: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k, fp: rows of whole buckets, sorted by bucket."""
    starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(k)])))
    for gap in range(1, 8):
        i = np.flatnonzero((k[gap:] == k[:-gap]) & (np.bitwise_count(fp[gap:] ^ fp[:-gap]) <= max_bits) & (fp[gap:] != fp[:-gap]))
        if len(i):
            yield fp[i], fp[i + gap]
    for at, n in zip(starts[sizes > 8], sizes[sizes > 8]):
        yield from forest(np.unique(fp[at : at + n]), max_bits)


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): verified links between distinct fingerprints that connect all that are within max_bits."""
    if max_bits > MAX_BITS:
        raise ValueError(f"keys find links of at most {MAX_BITS} bits, not {max_bits}")
    golay = Golay()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                fps = batch.column(0).slice(at, 1024).to_numpy(zero_copy_only=False)
                keys, rows = bucket_rows(fps, golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array((keys & 1).astype(bool)), pa.array(fps[rows])], names=["k", "base", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(k: np.ndarray, base: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(k):
                return
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(k)])))
            use = np.repeat((np.add.reduceat(base.astype(np.int64), starts) > 0) & (sizes > 1), sizes)
            got = list(bucket_links(k[use], fp[use].view(np.uint64), max_bits)) if use.any() else []
            if got:
                pairs = np.unique(np.stack([np.concatenate(x).view(np.int64) for x in zip(*got)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            whole = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last bucket may go on
            yield from found(*(x[:whole] for x in now))
            held = [x[whole:] for x in now]
        if held is not None:
            yield from found(*held)

    spread_out = distinct.select("fp").mapInArrow(spread, "k long, base boolean, fp long")
    met = spread_out.repartition("k").sortWithinPartitions("k").mapInArrow(meet, "a long, b long")
    return met.distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for every row of docs (doc_id long, text string).

    Texts with equal fingerprints are one node; links join nodes at max_bits or fewer differing bits.
    component_id is the smallest doc_id reachable; kept marks that row. Null and empty texts have
    fingerprint zero and so form one component. A null doc_id is never the smallest unless alone;
    repeated doc_ids give repeated rows. No rows give no rows. Texts are read whole, however long; columns
    of docs other than doc_id and text aren't read, whatever their names. max_bits is 3 at most.
    """
    fp = cut(fingerprints(docs, shingle))
    nodes = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("root"), F.count("*").alias("rows")))
    parts = cut(connected_components(links(nodes, max_bits)).select(F.col("node").alias("fp"), "component"))
    lowest = parts.join(nodes, "fp").groupBy("component").agg(F.min("root").alias("low"))
    of = cut(nodes.join(parts.join(lowest, "component").select("fp", "low"), "fp", "left").select("fp", "rows", F.coalesce("low", "root").alias("component_id")))
    out = join_hot(fp, of, ["fp"], "rows").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


# --- near duplicates at a similarity


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of runs of `size` words; a shorter text is one run, no words: none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64))


def votes(s: np.ndarray) -> np.ndarray:
    """Majority of each of 64 * VOTES bits over the shingles: how many have it, less how many haven't."""
    ones = np.zeros(VOTES * 64, np.int64)
    for at in range(0, len(s), 255):  # a byte holds the sum of 255 bits
        x = s[at : at + 255, None] * _MIX[0]
        x = (x ^ (x >> np.uint64(32))) * _MIX[1]
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        ones += bits.view(np.uint64).sum(0, dtype=np.uint64).view(np.uint8)
    return 2 * ones - len(s)


def codewords() -> np.ndarray:
    """(23, 4096) signs of the code's words, by index."""
    golay, heads = Golay(), np.arange(4096) << 11
    words = heads | golay.tables[0][heads & 255] ^ golay.tables[1][heads >> 8 & 255] ^ golay.tables[2][heads >> 16]
    return ((words[None, :] >> np.arange(23)[:, None] & 1) * 2 - 1).astype(np.float32)


def pair_keys(v: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """(texts, keys) of rows of votes: each pair of segments' nearest codewords, and which pair it is."""
    parts = v[:, : PARTS * 23].reshape(-1, 23).astype(np.float32)
    index = np.concatenate([(parts[at : at + 256] @ signs).argmax(1) for at in range(0, len(parts), 256)] or [np.zeros(0, np.int64)]).reshape(-1, PARTS)
    return (np.arange(len(PAIRS)) << 24 | index[:, PAIRS[:, 0]] << 12 | index[:, PAIRS[:, 1]]).astype(np.int32)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _set_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, node, n, sig, keys) of every row; node is a hash of its set, sig its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = codewords()
        for part, (texts,) in rows_of(batches, "text"):
            sets = [shingles(t) for t in texts]
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            v = np.array([votes(s) for s in sets]).reshape(-1, VOTES * 64)
            sig = list(np.packbits((v > 0) & (np.arange(VOTES * 64) < PARTS * 23), axis=1, bitorder="little").view(np.int64))
            keys = [k if len(s) else k[:0] for k, s in zip(pair_keys(v, signs), sets)]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int32()))], names=["doc_id", "k1", "k2", "node", "n", "sig", "keys"])

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, node long, n long, sig array<long>, keys array<int>")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, s): sorted sets as bytes, from rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (texts,) in rows_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t).tobytes() for t in texts], pa.binary())], names=["node", "s"])

    return docs.select("node", "text").mapInArrow(run, "node long, s binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike; few sets are broadcast, and a set that many pairs name is sent to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (x, y) in rows_of(batches, "x", "y"):
            good = [alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    few = (sets.agg(F.sum(F.octet_length("s"))).first()[0] or 0) <= BROADCAST_BYTES
    for end, to in (("a", "x"), ("b", "y")):
        own = sets.select(F.col("node").alias(end), F.col("s").alias(to))
        if few:
            pairs = pairs.join(F.broadcast(own), end)
        else:
            named = cut(pairs.groupBy(end).agg(F.count("*").alias("pairs")))
            pairs = join_hot(pairs, named.join(own, end), [end], "pairs").drop("pairs")
    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _may_be_alike() -> Column:
    """Of (n, sig) and (m, with_sig): sizes of sets and bits that texts at the least index can have."""
    apart = sum((F.bit_count(F.col("sig")[i].bitwiseXOR(F.col("with_sig")[i])) for i in range(VOTES)), F.lit(0))
    return (F.least("n", "m") * LEAST[1] >= F.greatest("n", "m") * LEAST[0]) & ((F.greatest("n", "m") <= SHORT) | (apart <= FAR))


def _components(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """(node, component) of the nodes that have a link, of (node, n, sig, keys); sets(nodes) gives (node, s).

    Every node is tried against one member of each of its buckets. What then isn't connected to its
    bucket's largest part is tried against all members of other parts, which is left for texts that share
    keys without being alike, and for few links besides.
    """
    spread, links = nodes.select(F.explode("keys").alias("key"), "node"), None
    facts = nodes.select("node", "n", "sig")
    others_facts = facts.toDF("with", "m", "with_sig")

    def linked(pairs: DataFrame) -> DataFrame | None:
        """(node, component) by these links (a, b) and all before."""
        nonlocal links
        pairs = cut(pairs.select(F.least("node", "with").alias("a"), F.greatest("node", "with").alias("b")).distinct())
        if not pairs.isEmpty():
            new = cut(_verified(pairs, cut(sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))))
            links = new if links is None else links.union(new)
        return None if links is None or links.isEmpty() else cut(connected_components(links))

    # the member drawn has the least xor with the key's hash, which gives it back
    mix = F.xxhash64("key", F.lit(0))
    drawn = spread.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(mix)).alias("o"), F.count("*").alias("members")).where("members > 1")
    drawn = cut(drawn.select("key", "members", F.col("o").bitwiseXOR(mix).alias("with")))
    met = cut(join_hot(spread, drawn, ["key"], "members").join(facts, "node"))
    parts = linked(met.where(F.col("node") != F.col("with")).join(others_facts, "with").where(_may_be_alike()))
    # of a bucket of two all pairs have been tried
    own = met.where("members > 2").select("key", "node", "n", "sig")
    own = own.withColumn("c", F.col("node")) if parts is None else own.join(parts.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    own = cut(own.select("key", "node", "n", "sig", "c"))
    per = own.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("members"), F.count("*").alias("many"))
    per = cut(per.where("many > 1").select("key", "members", F.col("top.c").alias("main")))
    if per.isEmpty():
        return parts
    a = cut(join_hot(own, per, ["key"], "members").where(F.col("c") != F.col("main")).select("key", "node", "n", "sig", "c"))
    b = cut(join_hot(own, per, ["key"], "members", "left_semi"))
    b = b.select(F.col("key").alias("k"), F.col("node").alias("with"), F.col("n").alias("m"), F.col("sig").alias("with_sig"), F.col("c").alias("d"))
    return linked(a.join(b, (F.col("key") == F.col("k")) & (F.col("c") != F.col("d")) & _may_be_alike()))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id long, text string and more) with one row of each group of near duplicates.

    A group is whatever links connect. Its row with the smallest doc_id stays, a null doc_id being above
    all others and a hash of the whole row deciding among equal ones; of identical rows one stays.
    Null texts and texts without words are one group. No rows give no rows. Texts are read whole, however
    long. Columns beside doc_id and text stay as they are, whatever their names.
    """
    whole = docs.select(F.struct("*").alias("row"), "doc_id", text_bytes().alias("text"), row_key(docs.columns, 1).alias("k1"), row_key(docs.columns, 2).alias("k2"))
    rows = cut(_set_rows(whole.select("doc_id", "k1", "k2", "text")))
    nodes = cut(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys")))

    def sets(able: DataFrame) -> DataFrame:
        of = rows.select("node", "k1", "k2").join(able, "node").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k")).select("node", "k.*")
        # identical rows bring a set twice
        return _sets(whole.select("k1", "k2", "text").join(of, ["k1", "k2"])).dropDuplicates(["node"])

    parts = _components(nodes, sets)
    of = rows.select("doc_id", "k1", "k2", F.col("node").alias("component")) if parts is None else rows.join(parts, "node", "left").select("doc_id", "k1", "k2", F.coalesce("component", "node").alias("component"))
    of = cut(of.select("k1", "k2", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2").alias("rank"), "component"))
    first = cut(of.groupBy("component").agg(F.min("rank").alias("low"), F.count("*").alias("size")).where("size > 1"))
    # (k1, k2, keep) of rows that have others in their group; all other rows stay
    told = join_hot(of, first, ["component"], "size").groupBy("k1", "k2").agg(F.first(F.col("rank") == F.col("low")).alias("keep"), F.count("*").alias("times"))
    told = cut(told.where("NOT keep OR times > 1"))
    marked = join_hot(whole.select("row", "k1", "k2"), told, ["k1", "k2"], "times", "left")
    one = marked.where("keep").dropDuplicates(["k1", "k2"])
    return marked.where("keep IS NULL").select("row.*").union(one.select("row.*"))
