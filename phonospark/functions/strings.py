"""String operators as column expressions: spelling, tokens, tone.

Everything but full Unicode normalization is built in; that one runs in an Arrow function, and only
for texts with characters beyond ASCII where the caller splits them off.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonospark.functions import tables
from phonospark.functions.resolver import CONVENTIONS, TIES, decompositions

COMBINING = r"̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯"
MODIFIERS = r"ʰ-˿ᴬ-ᵪᶛ-ᶿ⁰-₟"
CHAO = "".join(tables.CHAO)
PITCHED = "".join(c for c, v in tables.CHAO.items() if v)
_TIE, _C, _S = r"[͜͡]", f"[{CHAO}]", "[+.|‖]"
_M = rf"(?:(?![͜͡{CHAO}])[{COMBINING}{MODIFIERS}])"
_B = f"(?:(?!{_S}| |{_C}|{_TIE}|{_M}).)"
#: Tone runs, boundaries, then a base with its marks (ties join bases), then marks without a base.
TOKEN = f"(?s){_C}+|{_S}|(?:{_M}|{_TIE})*{_B}(?:{_M}*{_TIE}(?:{_M}|{_TIE})*{_B})*(?:{_M}|{_TIE})*|(?:{_M}|{_TIE})+"
#: Holds a syllable: a vowel letter (whatever marks follow) or a syllabic mark.
SYLLABIC = f"[{tables.VOWEL_LETTERS}̩̍]"


def constant_map(table: dict[str, str]) -> Column:
    """A map literal: written as one string, folded when the query is planned."""
    return F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in table.items())), F.lit("\x1e"), F.lit("\x1f"))


def _mapped(c: Column, table: dict[str, str]) -> Column:
    """Each character by the table, itself otherwise; one map lookup a character, no Python."""
    pairs = constant_map(table)
    each = F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(pairs, x), x))
    return F.when(c.rlike("[" + "".join(map(re.escape, table)) + "]"), F.array_join(each, "")).otherwise(c)


def after_slash(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^.*/(?=.)", "")


def strip_stress(c: Column) -> Column:
    return F.regexp_replace(c, "^[ˈˌ]+", "")


def literal_key(c: Column) -> Column:
    """Lookup key of the written form: known letters decomposed, no source conventions."""
    return _mapped(strip_stress(after_slash(c)), decompositions())


def lookup_key(c: Column) -> Column:
    """Lookup key with the spellings that sources use for IPA letters."""
    return _mapped(strip_stress(after_slash(c)), CONVENTIONS | decompositions())


def remove_ties(c: Column) -> Column:
    return F.translate(c, TIES, "")


def retract_affricate(c: Column) -> Column:
    return F.when(c == "tʃ", "t̠ʃ").when(c == "dʒ", "d̠ʒ").otherwise(c)


@F.pandas_udf(T.StringType())
def nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalize_grapheme(c: Column) -> Column:
    return nfc(F.translate(lookup_key(c), "g", "ɡ"))


def chao_digits(c: Column) -> Column:
    """ASCII tone digits as superscripts, as the tokenizer reads them (the resolver does not)."""
    return F.translate(c, "012345", "⁰¹²³⁴⁵")


def is_marker(c: Column) -> Column:
    return c.isin("+", "_", "#", "<?>") | (c.rlike(r"(?s)^<<.*>>$") & (F.octet_length(c) >= 4))


def is_combining(c: Column) -> Column:
    return c.rlike(f"^[{COMBINING}]")


def is_modifier(c: Column) -> Column:
    return c.rlike(f"^[{MODIFIERS}]")


def is_vowel_letter(c: Column) -> Column:
    return c.rlike(f"^[{tables.VOWEL_LETTERS}]")


def is_boundary(c: Column) -> Column:
    return c.rlike(f"^{_S}")


def chao_level(c: Column) -> Column:
    """Pitch level of a Chao character, null for any other."""
    return F.element_at(constant_map({k: str(v) for k, v in tables.CHAO.items()}), c).cast("int")


def segment(decomposed: Column) -> Column:
    """Orthographic tokens of a text that is in NFD with tone digits as superscripts."""
    return F.regexp_extract_all(decomposed, F.lit(TOKEN), F.lit(0))


def segment_ascii(c: Column) -> Column:
    """Tokens of a text with ASCII characters only, which need no normalization."""
    return segment(chao_digits(c))


def segment_ipa(c: Column) -> Column:
    return segment(chao_digits(nfd(c)))


def merge_tone_digits(tokens: Column) -> Column:
    """Tone tokens appended to the last syllabic token of the word; a neutral tone stays on its own.

    One fold: the tokens so far, and the 1-based place of the host (0: none).
    """
    start = F.struct(F.array().cast("array<string>").alias("items"), F.lit(0).alias("host"))

    def step(s: Column, t: Column) -> Column:
        tone = t.rlike(f"^[{CHAO}]+$") & t.rlike(f"[{PITCHED}]")
        n = F.size(s["items"])
        last = F.coalesce(F.get(s["items"], n - 1), F.lit(""))
        loose = last.rlike(f"^[{CHAO}]+$") & last.rlike(f"[{PITCHED}]")
        host = F.when(s["host"] > 0, s["host"]).when(loose, n).otherwise(0)
        joined = F.transform(s["items"], lambda x, i: F.when(i + 1 == host, F.concat(x, t)).otherwise(x))
        put = F.struct(F.concat(s["items"], F.array(t)).alias("items"), F.when(t == "+", 0).when(t.rlike(SYLLABIC), n + 1).otherwise(s["host"]).alias("host"))
        return F.when(tone & (host > 0), F.struct(joined.alias("items"), s["host"].alias("host"))).otherwise(put)

    return F.aggregate(tokens, start, step, lambda s: s["items"])


def merged(tokens: list[str]) -> list[str]:
    """The same on one list of tokens."""
    tone = re.compile(f"(?=.*[{PITCHED}])[{CHAO}]+", re.S)
    out: list[str] = []
    host = None
    for t in tokens:
        if tone.fullmatch(t):
            at = host if host is not None else len(out) - 1 if out and tone.fullmatch(out[-1]) else None
            if at is not None:
                out[at] += t
                continue
        if t == "+":
            host = None
        elif re.search(SYLLABIC, t):
            host = len(out)
        out.append(t)
    return out


def split_tone(c: Column) -> Column:
    """struct(status, base, tone): cut at the first tone character; a token of tone alone is unknown."""
    at = F.regexp_extract(c, f"(?s)^([^{CHAO}]*)(.*)$", 1)
    tone = F.regexp_extract(c, f"(?s)^([^{CHAO}]*)(.*)$", 2)
    bare = (at == "") & (tone != "")
    return F.struct(
        F.when(bare, "unknown-grapheme").otherwise("ok").alias("status"),
        F.when(~bare, at).alias("base"),
        F.when(~bare & (tone != ""), tone).alias("tone"),
    )


def contour(c: Column) -> Column:
    """array(onset, mid, offset) that a token of tone alone denotes; null for others, a neutral tone and long runs."""
    levels = F.transform(F.split(c, ""), chao_level)
    n = F.size(levels)
    at = lambda i: F.get(levels, F.lit(i))
    mid = F.when(n == 2, F.floor((at(0) + at(1) + 1) / 2).cast("int")).otherwise(F.get(levels, F.least(n - 1, F.lit(1))))
    return F.when(c.rlike(f"^[{PITCHED}]{{1,3}}$"), F.array(at(0), mid, F.element_at(levels, -1)))


# Spellings of one mark.
MARK_EQUIVALENTS = {"\u030a": "\u0325", "\u2019": "\u02bc", "'": "\u02bc"}


@F.pandas_udf(T.StringType())
def marks_key(tokens: pd.Series) -> pd.Series:
    """One key for all spellings of a base with the same marks, in any order or repeated; null if there is no base.

    Marks before the base and after it are two sets; length marks are counted.
    """

    def mark(c: str) -> bool:
        return unicodedata.category(c) in ("Mn", "Lm", "Sk") or c in MARK_EQUIVALENTS

    def key(token: str | None) -> str | None:
        chars = unicodedata.normalize("NFD", token or "")
        kinds = "".join("m" if mark(c) else "b" for c in chars)
        if not (m := re.fullmatch("(m*)(b+)(m*)", kinds)):
            return None
        before, base, after = (chars[slice(*m.span(k))] for k in (1, 2, 3))
        once = lambda marks: "".join(sorted({MARK_EQUIVALENTS.get(c, c) for c in marks}))
        return "\x1f".join([once(before), base, once(after.replace("ː", "")), str(chars.count("ː"))])

    return tokens.map(key)


def segment_ipa_merged(c: Column) -> Column:
    """Orthographic tokens with tones on their syllables."""
    return merge_tone_digits(segment_ipa(c))


def tsv_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
