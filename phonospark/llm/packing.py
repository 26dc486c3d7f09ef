"""Packing documents into fixed-length token sequences.

Documents are tokenised where they lie, cut into pieces of at most one sequence, and only the pieces'
sizes are moved: to randomised groups of some thousand documents, each packed on its own by first-fit
decreasing. The leftmost bin with room is found in a tournament tree over the bins' free capacities,
so a piece costs the logarithm of the number of bins.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonospark.llm.common import rows_of

LENGTH, END_ID = 2048, 1
#: Documents in a group on average; a group's pieces are packed in one task.
GROUP = 8192


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, by a tokenizers file.

    A byte-level BPE whose ids follow the order of its merges is a table of ranks, which tiktoken reads
    several times faster to the same ids; other files, and texts that it refuses or that hold the text of
    an added token (which has an id of its own, as the tokenizer reads it), go to tokenizers.
    """

    def __init__(self, tokenizer: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer)
        file = json.loads(Path(tokenizer).read_text(encoding="utf-8"))
        self.added = [t["content"] for t in file.get("added_tokens", [])]
        self.ranks = self._ranks(file)

    @staticmethod
    def _ranks(file: dict) -> tiktoken.Encoding | None:
        model, before = file["model"], file.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or file.get("normalizer") or model.get("dropout") or model.get("byte_fallback"):
            return None
        # the letters that stand for bytes: printable Latin-1 for themselves, the others from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        special = {t["content"] for t in file.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [ranks[bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if merged != list(range(256, 256 + len(merged))) or len(ranks) != 256 + len(merged):
            return None
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.ranks is not None and not any(x in text for x in self.added):
            try:
                return np.array(self.ranks.encode_ordinary(text), dtype="<u4").tobytes()
            except Exception:  # its pattern engine gives up on some very long runs
                pass
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """One for each worker process, as loading takes a second."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    return _encoders[tokenizer]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids array<int>]): documents cut every `length` ids."""
    return _pieces(docs, tokenizer, length, end_id, ids).drop("copy")


def _pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, ids: bool) -> DataFrame:
    """With `copy`, which tells apart rows that are there several times: their place in a task, then the task.

    It depends only on how many equal rows a task has, not on their order, so a task that runs again gives
    the same rows.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        seen: dict[tuple, int] = {}
        task = TaskContext.get().partitionId() + 1
        for _, (doc_ids, texts) in rows_of(batches, "doc_id", "text"):
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(doc_ids, texts):
                b = encode(text) + end
                n = len(b) // 4
                key = (doc_id, n, zlib.crc32(b))
                seen[key] = times = seen.get(key, -1) + 1
                copy = times and times * task
                for at in range(0, n, length):
                    part = b[4 * at : 4 * (at + length)]
                    row = (doc_id, at, len(part) // 4, zlib.crc32(part), n, copy)
                    for to, x in zip(out, row + (np.frombuffer(part, "<i4"),) * ids):
                        to.append(x)
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())] * ids
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy long" + ", ids array<int>" * ids
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size; sizes are at most capacity. Ties keep their order."""
    n = len(sizes)
    width = 1 << max(0, int(n - 1).bit_length())
    tree = [capacity] * (2 * width)  # tree[1] is the most room in any bin; bins not yet opened are empty
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[i]), 1
        while at < width:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i], offsets[i] = at - width, capacity - tree[at]
        tree[at] -= size
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP, ids: bool = False) -> DataFrame:
    """Pieces with (sequence_id, offset): gapless from 0 in sequences of at most `length` ids.

    With ids=True the pieces carry their token ids. Null and empty texts are one end id; repeated rows
    are packed each on its own and dealt to different groups; doc_id may be null. Pieces of equal size go by
    doc_id, then by start. Very long texts are cut into as many pieces as they take, all in one group. No
    rows give no rows. Columns of docs other than doc_id and text aren't read, whatever their names. A group
    holds only sizes (and ids where asked for), about `group` documents drawn by a hash.
    """
    groups = max(1, -(-docs.count() // group))
    parts = _pieces(docs, tokenizer, length, end_id, ids)
    kept = parts.withColumn("g", F.pmod(F.xxhash64("doc_id", "doc_tokens", "copy", F.lit(17)), F.lit(groups))).drop("copy")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        return pdf.drop(columns="g").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids + ", sequence_id long, offset long"
    return kept.groupBy("g").applyInPandas(fit, schema)


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids array<int>): pieces with ids put together, padded unless a power of two long."""
    parts = packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    gap = F.when(F.bit_count(n) == 1, 0).otherwise(F.lit(length) - n)
    return parts.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), gap)).alias("ids"))
