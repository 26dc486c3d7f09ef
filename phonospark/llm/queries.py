"""The operators as queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonospark.llm import decontam, embdedup, fim, htmlext, langid, line_dedup, packing, periodic, pii, simhash, substring, suffix, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_read(spark, sf_dir, "documents")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlext.extract_pages(_read(spark, sf_dir, "pages"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.linked(_read(spark, sf_dir, "embeddings"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeated(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def planted(doc_id: int | None, text: bytes) -> list[bytes]:
    """A text's words; one document in ten, by its id, ends in repetitions of a stretch of its own."""
    words = text.split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.collapse_runs(_read(spark, sf_dir, "documents"), planted)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = ["start", "length", "period", "exponent_milli"]
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeated(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(_read(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_pii": op3_pii,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_suffix_array": op9_suffix_array,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": """
        WITH l AS (
            SELECT row, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
            FROM (SELECT row_number() OVER () AS row, * FROM documents)),
        k AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM l),
        r AS (SELECT k, max(doc_id) AS top FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 3),
        m AS (SELECT k.*, r.top IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id < r.top) AS gone FROM k LEFT JOIN r USING (k))
        SELECT doc_id, count(*)::BIGINT AS n_lines, coalesce(sum(gone::INT), 0)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY row, doc_id""",
    "op8_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        w AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e)),
        ok AS (
            SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM w
            WHERE isfinite(list_inner_product(e, e)) AND list_inner_product(e, e) > 0),
        l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_inner_product(a.e, b.e) / a.n / b.n >= 0.93),
        r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        n AS (SELECT a, count(*) AS k FROM l GROUP BY a),
        c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
        SELECT v.vec_id, coalesce(n.k, 0)::BIGINT AS n_links, c.low AS component_id, v.vec_id = c.low AS kept
        FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a""",
    "op11_periodic_runs": """
        WITH t AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
        h AS (SELECT *, len(w)::BIGINT AS n,
                     coalesce(xor(list_reduce(flatten([[unicode(substr(doc_id::VARCHAR, k, 1)), -1, -1, -1, -1, -1, -1, -1, -1] FOR k IN range(1, length(doc_id::VARCHAR) + 1)])::BIGINT[],
                                              lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
                                              4294967295::BIGINT), 4294967295::BIGINT), 1) AS h FROM t),
        a AS (SELECT *, h % 10 = 0 AND n > 0 AS own, (h // 10) % greatest(n, 1) AS a FROM h),
        p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
        x AS (
            SELECT row, doc_id, n,
                   CASE WHEN own THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w
            FROM p),
        u AS (SELECT row, n, unnest(w) AS w, unnest(range(n)) AS i FROM x),
        -- places with their word, one list a word; all pairs of such places within a third of the text
        e AS (
            SELECT b.row, b.i AS i, c.i - b.i AS q FROM u b JOIN u c ON b.row = c.row AND b.w = c.w AND c.i > b.i AND 3 * (c.i - b.i) <= b.n),
        g AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM e),
        s AS (SELECT row, q, min(i) AS s, count(*) + q AS l FROM g GROUP BY row, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
        r AS (SELECT row, s, l, min(q) AS q FROM s GROUP BY row, s, l),
        best AS (SELECT row, arg_min((s, l, q), (-l::DOUBLE / q, s, q)) AS b, count(*) AS k, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY row),
        gone AS (SELECT DISTINCT row, unnest(range(s + q, s + l)) AS i FROM r),
        kept AS (SELECT u.row, string_agg(u.w, ' ' ORDER BY u.i) AS text FROM u ANTI JOIN gone ON u.row = gone.row AND u.i = gone.i GROUP BY u.row)
        SELECT x.doc_id, coalesce(best.k, 0)::BIGINT AS n_runs, b[1]::BIGINT AS start, b[2]::BIGINT AS length, b[3]::BIGINT AS period,
               (1000 * b[2] // b[3])::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM x LEFT JOIN best ON x.row = best.row LEFT JOIN kept ON x.row = kept.row""",
    "op12_substring_dedup": """
        WITH t AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
        v AS (SELECT row, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT row, w, unnest(range(1, len(w) - 33)) AS i FROM t)),
        m AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY s) AS k FROM v) WHERE k > 1),
        gone AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS i FROM m),
        u AS (SELECT row, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM t),
        kept AS (SELECT u.row, count(*) AS k, string_agg(u.w, ' ' ORDER BY u.i) AS text FROM u ANTI JOIN gone ON u.row = gone.row AND u.i = gone.i GROUP BY u.row)
        SELECT t.doc_id, len(t.w)::BIGINT AS n_words, (len(t.w) - coalesce(kept.k, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM t LEFT JOIN kept ON t.row = kept.row""",
    "op13_fill_in_middle": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
        h AS (
            SELECT *, [('0x' || d[8 * i + 1:8 * i + 8])::UBIGINT FOR i IN range(4)] AS h FROM t),
        f AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1))::BIGINT AS a, greatest(h[1] % (n + 1), h[2] % (n + 1))::BIGINT AS b,
                   CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                        WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM h),
        p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
}
