"""Fill-in-the-middle: a text's prefix, middle and suffix in another order, between sentinels.

The units are code points, as an untrained pre-tokenizer of the tokenizers library gives them: a Split whose
isolated matches are single code points. The array of their offsets (in the bytes of UTF-8) has a text's
length, and the offset at a rank is where a slice ends. A text is cut at blanks for that, as a match is one
code point whatever lies around it, and a worker pre-tokenizes a word once for all its uses. Rows don't
depend on each other, so the work stays where the texts lie.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString

from phonospark.llm.common import rows_of

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Per cent of texts that are transformed, and of these the per cent in suffix-prefix-middle order.
RATE, SPM = 90, 20
#: What the pre-tokenizer is given at once: a word with the blank after it, longer ones by 128 code points. Pieces
#: lie one after the other and leave nothing out.
PIECES = re.compile("[^ ]{1,127} ?| {1,128}")
#: Code points whose pieces are objects at once.
SECTION = 1 << 16
#: Pieces whose extents a worker remembers, and the most code points of one.
KNOWN, LONGEST = 1 << 18, 32
#: An extent is one number, so that sums of extents are sums of both: units above these bits, bytes of UTF-8 in them.
BITS = 32


@cache
def splitter():
    """One for each worker process."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex("(?m:.)"), "isolated")


def offsets(piece: str) -> list[tuple]:
    """Of each unit, where it starts and ends in UTF-8, in second place."""
    units = PreTokenizedString(piece)
    splitter().pre_tokenize(units)
    return units.get_splits("original", "byte")


class Extents(dict):
    """The extents of pieces. Offsets are objects and aren't kept; where there are too many pieces, it starts anew."""

    def __missing__(self, piece: str) -> int:
        own = offsets(piece)
        got = (len(own) << BITS) + own[-1][1][1]
        if len(piece) <= LONGEST:
            if len(self) >= KNOWN:
                self.clear()
            self[piece] = got
        return got


#: One for each worker process.
extents = Extents()


class Units:
    """A text's units by rank. Of its pieces only the sums of extents are kept, eight bytes each."""

    def __init__(self, text: str) -> None:
        self.text, self.ends = text, array("q", [0])
        for at in range(0, len(text), SECTION):
            self.ends.extend(accumulate(map(extents.__getitem__, PIECES.findall(text, at, at + SECTION)), initial=self.ends.pop()))

    def __len__(self) -> int:
        return self.ends[-1] >> BITS

    def end(self, rank: int) -> int:
        """Bytes of the first `rank` units."""
        if not rank:
            return 0
        k = bisect_left(self.ends, rank << BITS) - 1
        units, size = divmod(self.ends[k], 1 << BITS)
        return size + offsets(PIECES.match(self.text, units).group())[rank - units - 1][1][1]


def draws(seed: str) -> list[int]:
    """The first four groups of eight hexadecimal digits of the seed's SHA-256."""
    digest = sha256(seed.encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4)]


def transformed(text: str, seed: str, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, units of the prefix, of the middle, output)."""
    units, h, data = Units(text), draws(seed), text.encode()
    n = len(units)
    if not n or h[2] % 100 >= rate or any(x in text for x in SENTINELS):
        return n, "plain", None, None, data
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = units.end(first), units.end(second)
    parts = {PREFIX: data[:a], MIDDLE: data[a:b], SUFFIX: data[b:]}
    form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if h[3] % 100 < spm else ("psm", (PREFIX, SUFFIX, MIDDLE))
    return n, form, first, second - first, b"".join(x for mark in order for x in (mark.encode(), parts[mark]))


def fill_in_middle(docs: DataFrame, seed: str = "1:", rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs.

    The cuts, whether a text is transformed and in which order hang on seed and doc_id alone; a null doc_id
    draws as an empty one. Null and empty texts, and texts that hold a sentinel, are plain: the output is the
    text, the two counts are null. Repeated rows give equal rows, no rows give none. Texts are read whole,
    a word at a time. Columns of docs other than doc_id and text aren't read, whatever their names.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (doc_ids, texts) in rows_of(batches, "doc_id", "text"):
            out = [transformed(t, f"{seed}{'' if i is None else i}", rate, spm) for i, t in zip(doc_ids, texts)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = texts.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Its slices hold no sentinel, so sentinels cut them apart."""
    part = F.split(output, "|".join(SENTINELS), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
