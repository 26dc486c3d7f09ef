"""Fill-in-the-middle: units, cuts, orders, and exact round trips."""

import hashlib
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from phonospark.llm import fim

ODD = ["", "a", "\r\n", "é \U0001f468‍\U0001f469‍\U0001f467", "\x00\n ﻿", "日本語 кириллица", "<P", "P>", "<<S>", "<M", "<", "x" * 40_000, "é" * 16_384, "\U0001d4b3" * 16_385]


def plain(doc_id, text):
    h = [int(hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def test_units():
    for text in ODD:
        units = fim.Units(text)
        assert len(units) == len(text)
        for k in {0, 1, 127, 128, 129, 256, len(text) // 2, len(text) - 1, len(text)} & set(range(len(text) + 1)):
            assert units.end(k) == len(text[:k].encode())


def test_operator_and_round_trip(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab<>PSM \n𝒳") for _ in range(rng.randrange(40))) for _ in range(400)] + ["has <P> in it", "<S>", "<M>", None, "tie", "tie"]
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in enumerate(texts)], "doc_id long, text string, form string, n int")
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, text)
        assert r.back == text
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("rate, spm, forms", [(0, 20, {"plain"}), (100, 100, {"spm"}), (100, 0, {"psm"})])
def test_rates(spark, rate, spm, forms):
    docs = spark.range(50).selectExpr("id AS doc_id", "repeat('ab', cast(id + 1 AS int)) AS text")
    assert {r.form for r in fim.fill_in_middle(docs, rate=rate, spm=spm).collect()} == forms


def test_no_id_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "some text"), (None, "some text")], "doc_id long, text string")
    a, b = fim.fill_in_middle(docs).collect()
    assert a == b and (a.n, a.form, a.prefix_chars, a.middle_chars, a.output) == plain("", "some text")
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_a_word_is_pre_tokenized_once(monkeypatch):
    given, offsets = [], fim.offsets
    monkeypatch.setattr(fim, "offsets", lambda piece: given.append(piece) or offsets(piece))
    text = "слово  word\n𝒳 " * 5_000 + "é" * 1_000
    units = fim.Units(text)
    assert len(units) == len(text) and sum(map(len, given)) < 2_000
    assert max(map(len, given)) <= 128
    monkeypatch.setattr(fim, "extents", fim.Extents())
    monkeypatch.setattr(fim, "KNOWN", 2)
    assert len(fim.Units(text)) == len(text) and len(fim.extents) <= 2
    for k in (1, 6, 7, 8, 12, 13, 14, 69_999, 70_000, 70_001, 70_128, len(text)):
        assert units.end(k) == len(text[:k].encode())


def test_pieces_are_not_kept():
    text = "ab cd  𝒳é " * 200_000 + " " * 70_000
    tracemalloc.start()
    units = fim.Units(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(units) == len(text) and most < 20e6
    for k in (1, 65_535, 65_536, 65_537, 131_072, 1_999_999, 2_000_000, 2_000_001, 2_000_128, 2_000_129, len(text)):
        assert units.end(k) == len(text[:k].encode())
