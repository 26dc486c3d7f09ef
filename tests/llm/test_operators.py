"""The ten operators against SQL, brute force, round trips or held-out accuracy, and on edge cases."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from phonospark.llm import common, decontam, embdedup, htmlext, langid, line_dedup, packing, pii, queries, simhash, suffix, toxicity

DOCS = "doc_id long, text string, lang string, extra string"
EDGE = [(1, None, "en", "x"), (2, "", "en", "x"), (3, " \n\t\n", None, "y"), (4, "same words here again", "en", None), (4, "same words here again", "en", None), (None, "same words here again", "fr", "z"), (5, "12 34 !?", "de", "z"), (6, "long " * 30000, "es", "z")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# --- 1 packing


def check_packed(rows, want):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for doc_id, text in want:
        ids.setdefault(doc_id, np.array([*model.encode(text, add_special_tokens=False).ids, 1], "<u4"))
    seen = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(part.tobytes())
        seen.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    copies = {d: sum(1 for x, _ in want if x == d) for d in ids}
    assert {d: sorted(x) for d, x in seen.items()} == {d: sorted(list(range(len(ids[d]))) * copies[d]) for d in ids}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    return len(by)


def test_packing(spark, sf, docs):
    rows = queries.op1_packing(spark, sf).collect()
    n = check_packed(rows, texts(docs))
    assert sum(r.length for r in rows) / (2048 * n) > 0.97


def test_packing_edges(spark, edge, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_packed(packing.pack(edge, path).collect(), texts(edge))
    assert packing.pack(none, path).count() == 0
    seq = packing.sequences(packing.pack(edge, path, ids=True)).collect()
    assert all(len(r.ids) == 2048 or len(r.ids).bit_count() == 1 for r in seq)


def test_encoder_equals_tokenizers():
    import random

    from tokenizers import Tokenizer

    e, rng = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    signs = ["a", "the", "é", "1", "'s", " ", "  ", "\n", "\t", ".", "&&&", " ", "漢", "x'y", "<|endoftext|>", " foo", "_"]
    for _ in range(500):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(e(t), "<u4").tolist() == model.encode(t, add_special_tokens=False).ids
    assert np.frombuffer(e("a<|endoftext|>b"), "<u4").tolist() == [64, 50256, 65]
    assert e.ranks is not None
    assert packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).ranks is None


def test_repeated_rows_are_dealt_to_groups(spark):
    df = spark.createDataFrame([(1, "the same text")] * 400 + [(2, "another")], "doc_id long, text string").repartition(3)
    packed = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), group=40).collect()
    sizes = {}
    for r in packed:
        sizes[r.sequence_id >> 32] = sizes.get(r.sequence_id >> 32, 0) + 1
    assert len(packed) == 401 and len(sizes) == 11 and max(sizes.values()) < 90


def test_first_fit_decreasing():
    sizes = np.random.default_rng(0).integers(1, 101, 500)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        at = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if at == len(room):
            room.append(100)
        assert (bins[i], offsets[i]) == (at, 100 - room[at])
        room[at] -= sizes[i]


# --- 2 simhash


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(fp, ids, bits=3):
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= bits
    low = np.where([i is None for i in ids], np.iinfo(np.int64).max, [i or 0 for i in ids]).astype(np.int64)
    while True:
        new = np.where(near, low[None, :], np.iinfo(np.int64).max).min(1)
        if (new == low).all():
            return low
        low = new


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    want = texts(df)
    fp = np.array([fingerprint(t) for _, t in want], dtype=np.uint64)
    low = components(fp, [i for i, _ in want])
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == sorted((str(i), f"{int(f):016x}", int(c)) for (i, _), f, c in zip(want, fp, low))


def test_simhash_finds_all_links_of_three_bits(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    far = base.copy()
    for i in range(len(far)):
        for b in rng.choice(64, 1 + i % 3, replace=False):
            far[i] ^= np.uint64(1) << np.uint64(b)
    fps = spark.createDataFrame([(int(x),) for x in np.concatenate((base, far)).view(np.int64)], "fp long")
    parts = {r.node: r.component for r in common.connected_components(simhash.links(fps)).collect()}
    assert all(parts[a] == parts[b] for a, b in zip(base.view(np.int64).tolist(), far.view(np.int64).tolist()))
    assert len(set(parts.values())) == 400


def test_simhash_empty(none):
    assert simhash.near_duplicates(none).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(none, max_bits=4)


def test_components_of_a_long_chain(spark):
    e = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    got = common.connected_components(e).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}


# --- 3 personal data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def strict_spans(t):
    out = []
    for k, rx in enumerate(PATTERNS):
        for m in re.finditer(rx, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum((int(c) * (1 + i % 2)) // 10 + (int(c) * (1 + i % 2)) % 10 for i, c in enumerate(reversed(d))) % 10 == 0
            if (True, all(int(p) <= 255 for p in m[0].split(".") if p.isdigit()) if k == 1 else True, 14 <= len(d) <= 19 and luhn, 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark, docs, edge):
    hard = ["x a@b.c_d@e.f, é 1.2.3.4.5 +1 (743) 555-3824 256.1.1.1 4111 1111 1111 1111", "a@b.c a@b.c@d.e +12345678901 (0) 4111111111111111-", "0001.2.3.4 1.2.3.00255 99999999999999999999999999999999999999999.1.1.1", "1 " * 5000, "+" * 3000 + "1", "@" * 500 + "a" * 5000]
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(edge.select("doc_id", "text").where("doc_id < 4")).union(more)
    want = texts(df)
    got = pii.digest(pii.find(df)).collect()
    rows = sorted((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got)
    expect = []
    for i, t in want:
        s = strict_spans(t)
        expect.append((i, hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in s).encode()).hexdigest(), *(sum(x[1] == k for x in s) for k in range(4))))
    assert rows == sorted(expect)


def test_pii_of_very_many_spans(spark):
    text = " ".join(f"a{i}@b.com +1 (743) 555-{i % 10000:04d} or (743) 555-{i % 9999:04d}" for i in range(12_000))
    r = pii.digest(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in strict_spans(text))
    assert (r.n_email, r.n_phone) == (12_000, 12_000) and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_pii_adds_spans(spark):
    df = spark.createDataFrame([(1, "call (743) 555-3824; john (at) mail (dot) com"), (2, "a@b.com +1 (743) 555-3824")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(df)).collect()}
    assert got == {1: "phone:5:19,email:21:45", 2: "email:0:7,phone:8:25"}


# --- 4 line dedup


def test_line_dedup(spark, sf, duck):
    from conftest import same_rows

    same_rows(queries.op4_line_dedup(spark, sf), duck.sql(queries.ORACLE_SQL["op4_line_dedup"]))


def test_line_state_is_reversible(docs, spark):
    a, b = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")
    key = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    both = line_dedup.LineDedup.empty(spark, 3).insert(a).insert(b)
    assert key(both.apply(docs)) == key(line_dedup.dedup_lines(docs))
    assert key(both.delete(b).apply(a)) == key(line_dedup.dedup_lines(a))


def test_line_edges(spark, edge, none):
    line = "A line of more than twenty characters"
    df = spark.createDataFrame([(1, f"{line}\nx"), (2, f"  {line.upper()}\t"), (3, f"{line}\n{line}"), (None, line), (5, "short"), (6, None)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: ("x", 2, 1), 2: ("", 1, 1), 3: (f"{line}\n{line}", 2, 0), None: ("", 1, 1), 5: ("short", 1, 0), 6: ("", 1, 0)}
    assert line_dedup.dedup_lines(edge).count() == len(EDGE) and "extra" in line_dedup.dedup_lines(edge).columns
    assert line_dedup.dedup_lines(none).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys, others = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
    f = line_dedup.CuckooFilter.sized(5000)
    assert f.insert(keys) and f.contains(keys).all() and f.contains(others).mean() < 0.001
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    assert not line_dedup.CuckooFilter(16).insert(keys)


# --- 5 language


def test_language(spark, sf, docs):
    got = queries.op5_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_language_edges(edge, none):
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(edge).collect()]
    assert len(got) == len(EDGE) and {(1, "und"), (2, "und"), (3, "und"), (5, "und")} <= set(got)
    assert langid.identify(none).count() == 0


# --- 6 decontamination


def test_tiling_catches_reordered_passages(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    w = item.split()
    cases = [(1, "Before, " + item.upper() + "! after"), (2, " ".join(w[6:]) + " between " + " ".join(w[:6])), (3, " ".join(w[:6])), (4, " ".join(reversed(w))), (5, None), (6, ""), (7, item + " " + item)]
    df = spark.createDataFrame(cases, "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, "too short"), (12, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tiles, r.coverage) for r in decontam.contamination(df, bench).collect()}
    assert got == {(1, 10): (1, 1.0), (2, 10): (2, 1.0), (7, 10): (1, 1.0)}
    assert {r.doc_id for r in decontam.decontaminate(df, bench).collect()} == {3, 4, 5, 6}
    split = decontam.contamination(df, bench, broadcast_bytes=0)
    assert {(r.doc_id, r.item_id) for r in split.collect()} == set(got)


def test_tiling_equals_brute_force():
    rng = np.random.default_rng(2)
    for kinds in (2, 3, 4) * 25:
        item, doc = rng.integers(0, kinds, 24), rng.integers(0, kinds, 60)
        doc[:3] = -1
        used_d, used_t, want = set(), set(), []
        while True:
            best = (0, 0, 0)
            for j in range(60):
                for i in range(24):
                    n = 0
                    while i + n < 24 and j + n < 60 and doc[j + n] == item[i + n] and j + n not in used_d and i + n not in used_t:
                        n += 1
                    best = max(best, (n, -j, -i))
            n, j, i = best[0], -best[1], -best[2]
            if n < 5:
                break
            used_d |= set(range(j, j + n))
            used_t |= set(range(i, i + n))
            want.append((j, i, n))
        seeds = {item[i : i + 5].tobytes() for i in range(20)}
        assert decontam.tile(doc, item, np.array([j for j in range(56) if doc[j : j + 5].tobytes() in seeds], int), 5) == want


def test_tiling_of_one_repeated_word_is_fast():
    import time

    began = time.time()
    assert list(decontam.Items([(1, "a " * 20_000)], 5).matches("a " * 50_000)) == [(0, 20_000, 1)]
    assert time.time() - began < 5


def test_decontamination_by_a_join_of_seeds(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = docs.union(docs.where("doc_id < 50"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    sent, joined = decontam.contamination(docs, bench), decontam.contamination(docs, bench, broadcast_bytes=0)
    assert rows(sent) == rows(joined) != []
    assert rows(decontam.decontaminate(docs, bench).select("doc_id")) == rows(decontam.decontaminate(docs, bench, broadcast_bytes=0).select("doc_id"))


def test_decontamination(spark, sf):
    got = queries.op6_decontamination(spark, sf).collect()
    assert all(r.coverage >= 0.8 for r in got)
    body = {r.doc_id: " ".join(decontam.words_of(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: " ".join(decontam.words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    whole = {(d, i) for i, t in items.items() if len(t.split()) >= 5 for d, x in body.items() if f" {t} " in f" {x} "}
    assert whole <= {(r.doc_id, r.item_id) for r in got}


# --- 7 pages

PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><div id="sidebar"><ul><li><a href=1>a</a></ul></div>
<div class="content"><h2>Title &amp; more</h2><p>First paragraph, with commas, and text that goes on for a while.<p>Second   one,
 with <b>bold</b> and <a href=x>link</a>.<ul><li>one<li>two</ul><table><tr><td>cell<td>cell2</table><div class="comments"><p>Reader says, this is long, very long, text.</p></div></div>
<form><p>Form text</p></form><script>var a="<p>no</p>"</script><footer>foot</footer></body></html>"""


def test_page():
    assert htmlext.extract(PAGE).split("\n") == ["Title & more", "First paragraph, with commas, and text that goes on for a while.", "Second one, with bold and link.", "one", "two", "cell", "cell2"]
    assert htmlext.extract(None) == htmlext.extract("") == htmlext.extract("<nav>a</nav>") == ""
    assert htmlext.extract("plain") == "plain" and htmlext.extract("<p>a<p>b &lt;c&gt;") == "a\nb <c>"


def test_marks():
    page = '<div class="page has-sidebar"><div class="text"><p>Some text, long enough to be read as such, and more.</p></div><ol class="commentlist"><li>Nice, very nice, really, so nice, I say</ol><div class="widget-area sidebar-left"><p>Aside, as it were, of some length.</p></div></div>'
    assert htmlext.extract(page) == "Some text, long enough to be read as such, and more."


def test_pages(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op7_html_extraction(spark, sf).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        import html

        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0][:3] == "<br" else "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(filter(None, want)) and r.n_chars == len(r.text)


# --- 8 embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 64))
    near = base[:40] + 0.03 * rng.standard_normal((40, 64))
    v = np.concatenate((base, near, base[:5])).astype(np.float32)
    rows = [(i, [float(x) for x in e], i % 60 % 3) for i, e in enumerate(v)]
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] + [1.0] * 63, 1), (903, [None] + [1.0] * 63, 1), (904, rows[0][1], None), (905, [], 2), (906, [1.0] * 3, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embdedup.linked(df, block=16).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    label = np.arange(len(v)) % 60 % 3
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    low = components_of(near)
    for i in range(len(v)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, low[i], low[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i, *_ in odd) and len(got) == len(rows + odd)
    assert embdedup.linked(df.where("vec_id < 0")).count() == 0


def test_cells_of_a_large_label(spark, monkeypatch):
    """A label of many classes is cut into cells; links, counts and components are those of all pairs."""
    monkeypatch.setattr(embdedup, "WHOLE", 0)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 64))
    v = np.concatenate((base, base[:200] + 0.25 * rng.standard_normal((200, 64)) * rng.random((200, 1)), base[:1] + 0.2 * rng.standard_normal((80, 64))))
    df = spark.createDataFrame([(i, e.tolist(), 3) for i, e in enumerate(v)], "vec_id long, embedding array<double>, label int")
    assert embdedup.halves(len(v), 32) == 8 and embdedup.tables(8, 0.93) == 21
    got = {r.vec_id: r for r in embdedup.linked(df, block=32).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.93
    low = components_of(near)
    assert 100 < (near.sum(1) > 1).sum() < len(v)
    assert all((got[i].n_links, got[i].component_id) == (near[i].sum() - 1, low[i]) for i in range(len(v)))


@pytest.mark.parametrize("whole", [embdedup.WHOLE, 0])
def test_recall_of_planted_pairs(spark, monkeypatch, whole):
    """Pairs just above the limit, in one cell and in many."""
    monkeypatch.setattr(embdedup, "WHOLE", whole)
    rng = np.random.default_rng(9)
    base, noise = rng.standard_normal((2, 1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise -= (noise * base).sum(1)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    c = rng.uniform(0.9301, 0.95, 1500)[:, None]
    v = np.concatenate((base, c * base + np.sqrt(1 - c * c) * noise))
    df = spark.createDataFrame([(i, e.tolist(), 0) for i, e in enumerate(v)], "vec_id long, embedding array<double>, label int")
    found = embdedup.linked(df, block=512).where("n_links > 0").count()
    assert found >= 0.999 * len(v)


def components_of(near):
    low = np.arange(len(near))
    while True:
        new = np.where(near, low[None, :], 1 << 40).min(1)
        if (new == low).all():
            return low
        low = new


def test_recall_of_the_count():
    assert embdedup.least_count(48, 1.0, 0.9999) == 20 and embdedup.least_count(24, 1.0, 0.9999) == 8


# --- 9 suffix arrays


def repeated(bodies, n=200):
    seen = {}
    for d, t in enumerate(bodies):
        for i in range(len(t) - n + 1):
            seen.setdefault(t[i : i + n], []).append((d, i))
    out = [np.zeros(len(t), bool) for t in bodies]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                out[d][i : i + n] = True
    return out


def hold_suffix(df):
    want = [(i, t.encode()) for i, t in texts(df)]
    expect = []
    for (i, t), m in zip(want, repeated([t for _, t in want])):
        kept = bytes(np.frombuffer(t, np.uint8)[~m])
        expect.append((str(i), len(t), int(m.sum()), int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = suffix.remove_repeated(df).select(F.col("doc_id").cast("string"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(tuple(str(x) if k == 0 else x for k, x in enumerate(r)) for r in got) == sorted(expect)


def test_suffix(docs):
    hold_suffix(docs)


def test_suffix_edges(spark, none):
    p = "".join(chr(97 + i * i % 23) + " "[i % 3 :] for i in range(260))
    hard = [p, p[:230] + "x", "ab" * 300, "a" * 250, "a" * 199, "", None, "\0" * 260, p[40:] + "é" * 150, "é" * 150 + "z", p, "q" + p[:200]]
    hold_suffix(spark.createDataFrame([(i if i else None, t) for i, t in enumerate(hard)], "doc_id long, text string"))
    assert suffix.remove_repeated(none).count() == 0


def test_suffix_arrays_are_sorted():
    rng = np.random.default_rng(0)
    for many in (1, 5, 40, 90):  # one by one, and side by side
        for _ in range(8):
            texts = [np.append(rng.integers(1, 1 + int(rng.integers(1, 5)), int(rng.integers(0, 80))), 0).astype(np.uint16) for _ in range(many)]
            size = np.array([len(x) for x in texts])
            begin = np.cumsum(size) - size
            sa = suffix.suffix_arrays(np.concatenate(texts), begin, size)
            for x, b, n in zip(texts, begin, size):
                x = x.tolist()
                want = sorted(range(n), key=lambda i: x[i:])
                assert (sa[b : b + n] - b).tolist() == want == suffix.sort_one(x, max(x) + 1)


def test_anchors_of_a_long_text_are_read_in_pieces(monkeypatch):
    text = bytes(np.random.default_rng(3).integers(97, 101, 5000).astype(np.uint8))
    whole = suffix.anchors(text)
    monkeypatch.setattr(suffix, "PIECE", 700)
    at, h, first, last = suffix.anchors(text)
    # the same windows have the same anchors
    assert np.repeat(at, last - first + 1).tolist() == np.repeat(whole[0], whole[3] - whole[2] + 1).tolist()
    assert first[0] == 0 and last[-1] == len(text) - 200 and (first[1:] == last[:-1] + 1).all()


# --- 10 toxicity


def test_toxicity(spark):
    got = queries.op10_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    clean = [r.predicted for r in held if r.toxic == 0]
    assert np.mean(clean) < 0.01


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(4, 1), (6, None)], "doc_id long, toxic int")
    assert toxicity.score(edge, labels).count() == len(EDGE) and toxicity.score(none, labels).count() == 0


def test_grammar():
    g = toxicity.Grammar()
    P, I, N, R, T, O, E = toxicity.PATTERNS, toxicity.INSULT, toxicity.NEGATION, toxicity.REPORT, toxicity.TARGET, toxicity.OTHER, toxicity.END

    def found(*classes):
        f = g.features(list(classes))
        return {P[i]: round(float(np.expm1(x))) for i, x in enumerate(f[:-1]) if x}

    assert found(T, O, I) == {("insult", 1, 0, 0): 1}
    assert found(N, O, I) == {("insult", 0, 1, 0): 1} and found(N, O, O, O, O, I) == {("insult", 0, 0, 0): 1}
    assert found(R, O, O, O, O, O, I) == {("insult", 0, 0, 1): 1} and found(R, E, I) == {("insult", 0, 0, 0): 1}
    assert found(T, toxicity.THREAT, I) == {("threat", 1, 0, 0): 1, ("insult", 1, 0, 0): 1}
