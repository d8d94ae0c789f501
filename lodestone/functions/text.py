"""Text expressions: Columns in, Columns out; white space and word borders are ASCII, so that plans and SQL agree."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import citations

SPACE = r"[ \t\n\r\f\x0B]+"

# Patterns of reference lists, captions and debris.
REFERENCE_BLOCK = r"(?i)(?:\b(?:19|20)\d{2}\b.*?(?:;|\(|:).{0,40}?\b\d{1,4}\b)|(?:\bet al\.\b)|(?:\bdoi\s*[:=]\s*\S+)|(?:\bpmid\s*[:=]\s*\d+)|(?:[A-Z][a-z]+\s+[A-Z][a-z]+,\s*\b(?:19|20)\d{2}\b)"
CAPTION = r"(?i)\bfig(?:ure)?\b|\bsource:|click|©"
INDEX_CAPTION = r"(?i)\b(fig|figure|source|click|image|photo|credit)\b"
REFERENCE_HEADING = r"(?i)^(references|bibliography)\b"
CAUSAL_CUES = ("because", "since", "therefore", "hence", "thus", "so that", "leads to", "results in", "due to", "as a result")
ODD_NUMBERS = r"(^\s*\(?\d+(?:\s*,\s*\d+){1,}\)?\s*)|(\b\d{1,2}\s*,\s*\d{1,2}\s*,\s*\d{1,2})"
PATIENT_PHRASES = ("the patient ", "this patient ", "our patient ", "she had been diagnosed", "he had been diagnosed", "she was diagnosed", "he was diagnosed")
PATIENT_AGE = r"\b\d{1,2}\s*(year[- ]old|years old|year[- ])"
SIMPLE_QUESTION = r"(?i)\b(exercise|exercises|when to|how often|how long|frequency|reps?|sets?|timing|dose|doseing)\b"
MOJIBAKE = ("â", "Â", "�", "‚Ä", "√")
# Mis-decoded sequences and what they stood for, in the order of use; leftover pairs that are deleted; then letters.
REPAIRS = (
    ("â€“", "–"), ("â€”", "—"), ("â€˜", "'"), ("â€™", "'"), ("â€œ", '"'), ("â€\u009d", '"'), ("â€¦", "…"), ("Â ", ""), ("Â", ""),
    ("â€¢", "•"), ("â€ ", "– "), ("‚Ä´", "'"), ("‚Ä¬", "–"), ("‚Ä®", "–"), ("‚Äº", '"'), ("‚Ä¹", '"'), ("\ufffd", ""),
    ("√©", "é"), ("√®", "è"), ("√¢", "â"), ("√ª", "ê"), ("√±", "ñ"), ("‚Ä´s", "'s"), ("¬", ""), ("\u0301", ""),
    ("’Â", "’"), ("Â’", "’"), ("Â«", "«"), ("Â»", "»"),
)
LEFTOVERS = r"(?:Ã.|â.|Â.|√.|\ufffd|‚Ä.|â€¦|â€¢)+"
LETTERS = (
    ("√¶", "ö"), ("√ö", "ö"), ("√õ", "ö"), ("√ñ", "Ñ"), ("√ò", "ò"), ("√ó", "ó"), ("√ú", "ú"), ("√ü", "ü"), ("√à", "à"), ("√á", "á"),
)
LAST_LETTERS = (("√", ""), ("Ä쬆", "Á"), ("Ä", "A"))


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(c: Column) -> Column:
    """White-space separated words; none in an empty or null text."""
    return F.filter(F.split(text_of(c), SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    """size(words(c)), without a look at each word."""
    t = F.btrim(text_of(c), F.lit(" \t\n\r\f\x0b"))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, SPACE)))


def tokens_of_words(n: Column) -> Column:
    """Tokens by the chunker's rule: words over 0.75, cut off."""
    return F.floor(n / F.lit(0.75)).cast("int")


def chunk_tokens(c: Column) -> Column:
    return tokens_of_words(word_count(c))


def query_tokens(c: Column) -> Column:
    """Tokens by the packer's rule: words times 1.33, half to even."""
    return F.bround(word_count(c) * F.lit(1.33)).cast("int")


def fingerprint(c: Column) -> Column:
    """Digest of a text without case and repeated white space."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text_of(c)), SPACE, " ")), 256)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(text_of(c), r"(?<=[.!?])\s+(?=[A-Z(])"), lambda s: F.trim(s)), lambda s: s != "")


def clauses(sentence: Column) -> Column:
    """Parts after : ; , — - and closing parentheses, and after a full stop before a capital or a digit; the sentence where there is none."""
    parts = F.filter(F.transform(F.split(sentence, r"(?<=[:;,—)-])\s+|(?<=\.)\s+(?=[A-Z0-9])"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(sentence))


def is_reference_block(c: Column) -> Column:
    return text_of(c).rlike(REFERENCE_BLOCK)


def is_caption(c: Column) -> Column:
    return text_of(c).rlike(CAPTION)


def is_bad_chunk(c: Column, least: int = 50) -> Column:
    """Too short for the index, or a caption."""
    t = F.trim(text_of(c))
    return (F.length(t) < least) | t.rlike(INDEX_CAPTION)


def looks_odd(c: Column) -> Column:
    return F.substring(F.trim(text_of(c)), 1, 80).rlike(ODD_NUMBERS)


def has_mojibake(c: Column, needles: Sequence[str] = MOJIBAKE) -> Column:
    return text_of(c).rlike("|".join(needles))


def is_patient_story(c: Column) -> Column:
    t = F.lower(text_of(c))
    return t.rlike(PATIENT_AGE) | t.rlike("|".join(PATIENT_PHRASES))


def is_simple_question(c: Column) -> Column:
    return text_of(c).rlike(SIMPLE_QUESTION)


def sanitized(c: Column, placeholder: str = "[EMPTY]") -> Column:
    t = F.trim(text_of(c))
    return F.when(F.lower(t).isin("", "none", "nan", "null", "[]", "{}"), placeholder).otherwise(t)


def without_citations(c: Column) -> Column:
    """Number clusters, citing parentheses and inline citations go; see citations.without_citations, which matches backwards from years as no built-in function can."""
    return _per_text(citations.without_citations)(text_of(c))


def without_bibliography(c: Column, min_words: int = 50) -> Column:
    """The text up to the first bibliographic pattern; empty if under half of min_words are left; texts under 60 characters as they are."""
    return _per_text(functools.partial(citations.without_bibliography, min_words=min_words))(text_of(c))


def repaired_text(text: str, aggressive: bool = False) -> str:
    """Mis-decoded text put right, in compatibility normal form, white space tidied.

    aggressive also deletes leftover pairs and lone signs and turns Ä into A,
    which harms texts that hold those letters rightly.
    """
    for bad, good in REPAIRS:
        text = text.replace(bad, good)
    if aggressive:
        text = re.sub(LEFTOVERS, "", text)
    for bad, good in LETTERS + (LAST_LETTERS if aggressive else ()):
        text = text.replace(bad, good)
    return re.sub(r"\s{2,}", " ", unicodedata.normalize("NFKC", text)).strip()


def repaired(c: Column, aggressive: bool = False) -> Column:
    """repaired_text of each text, which needs a normal form that no built-in function gives; a null is empty."""
    return _per_text(functools.partial(repaired_text, aggressive=aggressive))(text_of(c))


def _per_text(f: Callable[[str], str]):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return F.pandas_udf(run, "string")


def first_tokens(c: Column, most: int, tokenizer: str) -> Column:
    """The text up to the end of its first `most` tokens, by the tokenizer file at a path that every executor has; null stays null."""

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)

        def head(text: str) -> str:
            ends = t.encode(text, add_special_tokens=False).offsets
            return text if len(ends) <= most else text[: ends[most - 1][1]] if most > 0 else ""

        for s in batches:
            yield s.map(head, na_action="ignore")

    return F.pandas_udf(cut, "string")(c.cast("string"))


def header(title: Column, section: Column) -> Column:
    return F.trim(F.regexp_replace(F.concat(text_of(title), F.lit(" · "), text_of(section)), "^[ ·]+|[ ·]+$", ""))


def html_escaped(c: Column) -> Column:
    t = text_of(c)
    for bad, good in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(bad), F.lit(good))
    return t


def words_to_tokens(n: Column) -> Column:
    """Tokens of a number of words, half to even."""
    return F.bround(n * F.lit(1.33)).cast("int")


def metadata_value(c: Column, dtype: str) -> Column:
    """A value fit for an index: arrays joined by ", ", NaN as null, other scalars as they are."""
    if dtype.startswith("array"):
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ", ", "None")
    return F.nanvl(c, F.lit(None).cast(dtype)) if dtype in ("float", "double") else c


def two_lines(c: Column, width: int = 120) -> Column:
    """The first two lines of a text, each cut to a width."""
    return F.array_join(F.transform(F.slice(F.split(text_of(c), "\n"), 1, 2), lambda x: F.substring(x, 1, width)), "\n")


def texts_of_ids(c: Column) -> Column:
    """A list of ids as texts; none for a null."""
    return F.transform(F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")), lambda x: x)


def snippet(c: Column, most: int = 800) -> Column:
    t = text_of(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(" …"))).otherwise(t)


def chunk_index(c: Column) -> Column:
    """(block, part) of an index like "3" or "3.1"; null where it is neither."""
    t = F.trim(text_of(c))
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), F.struct(F.regexp_extract(t, r"^(\d+)", 1).cast("int").alias("block"), F.coalesce(F.nullif(F.regexp_extract(t, r"\.(\d+)$", 1), F.lit("")).cast("int"), F.lit(0)).alias("part")))


def rerank_scores(reply: Column, n: Column) -> Column:
    """Scores in a scorer's reply, n of them: comma-separated where it has a comma, else all its numbers; clamped to 0..10; null if one can't be read."""
    t = text_of(reply)
    by_comma = F.transform(F.split(t, ","), lambda x: F.trim(x).try_cast("double"))
    by_number = F.transform(F.regexp_extract_all(t, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))
    raw = F.when(F.contains(t, F.lit(",")), by_comma).otherwise(by_number)
    full = F.slice(F.concat(raw, F.array_repeat(F.lit(0.0), n)), F.lit(1), n)
    clamped = F.transform(full, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(10.0)))
    return F.when(F.exists(full, lambda x: x.isNull()), F.lit(None)).otherwise(clamped)


def category_letter(reply: Column) -> Column:
    """The first letter of a classifier's reply, D where it is empty; it isn't checked against the known ones."""
    return F.coalesce(F.nullif(F.substring(F.upper(F.trim(text_of(reply))), 1, 1), F.lit("")), F.lit("D"))


def category_name(letter: Column, names: dict[str, str]) -> Column:
    out = F
    for k, v in names.items():
        out = out.when(letter == k, v)
    return out.otherwise("Unknown")


def plain_index(c: Column) -> Column:
    """An index as a whole number, ".0" cut off; -1 where it is none."""
    t = F.regexp_replace(F.trim(text_of(c)), r"\.0$", "")
    return F.when(t.rlike(r"^-?\d+$"), t.try_cast("int")).otherwise(-1)
