"""What bytes and wrongly decoded texts stood for: a guess of a page's charset, and a search over decodings."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte order marks, the longest first.
MARKS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
# Single-byte charsets, in the order in which equal guesses count, with the letters that their languages use most.
WESTERN, CENTRAL, CYRILLIC = "éèêëàâçîïôûùüöäßáíóúñœæå¿¡", "ąćęłńóśźżěščřžýáíéúůťďňőűăâîşţöüä", "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
CHARSETS = (("cp1252", WESTERN), ("cp1250", CENTRAL), ("iso8859_2", CENTRAL), ("cp1251", CYRILLIC), ("koi8_r", CYRILLIC), ("iso8859_5", CYRILLIC))
#: Bytes beyond ASCII that a guess looks at, evenly from the whole content's different words: a line that recurs counts once.
LOOKS = 20_000
#: Latin texts have no run of so many letters beyond ASCII.
LATIN_RUN = 3


@functools.cache
def _letters(charset: str) -> list[str]:
    return [bytes([b]).decode(charset, "replace") for b in range(256)]


def _likely(places: list[int], raw: bytes, charset: str, usual: str) -> float:
    """How well the bytes beyond ASCII fit among their neighbours as letters of a charset."""
    chars, latin, score = _letters(charset), usual is not CYRILLIC, 0.0
    for i in places:
        c = chars[raw[i]]
        before, after = chars[raw[i - 1]] if i else " ", chars[raw[i + 1]] if i + 1 < len(raw) else " "
        inside = before.isalpha() and after.isalpha()
        if c == "�" or unicodedata.category(c) == "Cc":
            score -= 10
        elif not c.isalpha():
            score -= 4 if inside else -2 if c in usual else 0
        else:
            score += 2 if c.lower() in usual[: 20 if not latin else None] else 1 if c.lower() in usual else 0
            score -= 3 if (c.isupper() and before.islower()) or (c.islower() and after.isupper()) else 0
            beyond = [x.isalpha() and x > "\x7f" for x in (before, after)]
            score += (-2 if all(beyond) else 0) if latin else (1 if any(beyond) else -2)
            score -= 10 if not latin and any(x.isalpha() and x <= "\x7f" for x in (before, after)) else 0  # no word has letters of both scripts
    return score


def charset_of(raw: bytes) -> str:
    """The charset of bytes: by a byte order mark, by zeros as UTF-16 has them, UTF-8 where they are that, else the single-byte one whose letters fit best."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return name
    even, odd = raw[0::2].count(0), raw[1::2].count(0)
    if len(raw) >= 4 and max(even, odd) > 0.3 * (len(raw) // 2) and min(even, odd) < 0.1 * max(even, odd):
        return "utf-16-be" if even > odd else "utf-16-le"
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    words = b" ".join(dict.fromkeys(w for w in re.findall(rb"[A-Za-z\x80-\xff]+", raw) if not w.isascii()))
    high = [m.start() for m in re.finditer(rb"[\x80-\xff]", words)]
    places = high[:: max(1, len(high) // LOOKS)]
    scores = [_likely(places, words, name, usual) for name, usual in CHARSETS]
    return CHARSETS[scores.index(max(scores))][0]


def text_of_bytes(raw: bytes) -> str:
    """The text of bytes in the charset that they seem to have, without its mark; what can't be read is U+FFFD."""
    return raw.decode(charset_of(raw), "replace").removeprefix("﻿")


def decoded(content: Column) -> Column:
    """The text of bytes: UTF-8 in Spark itself, anything else by a guess; null stays null."""

    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda b: text_of_bytes(bytes(b)), na_action="ignore")

    raw = content.cast("string")
    plain = F.is_valid_utf8(raw) & ~F.contains(raw, F.lit("\x00"))
    other = F.pandas_udf(guess, "string")(F.when(~plain, content))
    return F.when(plain, F.regexp_replace(raw, "^﻿", "")).otherwise(other)


# Charsets that UTF-8 is often taken for, and in how many sequences in a row that is believed.
TAKEN_FOR = (("cp1252", 1), ("mac_roman", 1), ("cp1251", 3))
_ROUNDS = 4


@functools.cache
def _table(charset: str) -> dict[str, int]:
    """Bytes beyond ASCII by the character that a decoder shows for them; bytes without one show as control characters, and all of those do in Latin-1, which goes with cp1252."""
    out = {chr(b): b for b in range(0x80, 0xA0)} if charset == "cp1252" else {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@functools.cache
def _sequences(charset: str) -> re.Pattern:
    of = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in sorted(_table(charset).items()) if lo <= b <= hi) + "]"
    more = of(0x80, 0xBF)
    return re.compile(f"(?:{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF4)}{more}{{3}})+")


def _sound(c: str) -> bool:
    """Whether a character of two bytes is one that texts have: Latin letters and signs, Greek, Cyrillic, Hebrew, Arabic."""
    return "\xa0" <= c <= "ſ" or "Ͱ" <= c <= "Ͽ" or "Ѐ" <= c <= "џ" or "א" <= c <= "ۿ"


def _lettered(shown: str, new: str) -> bool:
    """Whether letters alone stand for one of the new characters: sound words have such runs in a charset whose bytes from 0x80 on are letters."""
    at = 0
    for c in new:
        n = len(c.encode())
        if shown[at : at + n].isalpha():
            return True
        at += n
    return False


def _tried(text: str, charset: str, least: int) -> tuple[int, str]:
    """(sequences read, text) with runs of UTF-8 in what a charset shows read anew.

    A sequence is weak if it is two characters of which the second is a quote,
    dash or the like, or if letters alone stand for one of a charset whose bytes are mostly letters: sound
    texts have such too. Weak ones count only beside others, those of letters beside more others.
    """
    table, found, letters = _table(charset), [], 0
    for m in _sequences(charset).finditer(text):
        try:
            new = bytes(table[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if not all(c > "߿" or _sound(c) or c in table for c in new):  # what the charset shows can be read anew in the next round
            continue
        lettered = charset == "mac_roman" and _lettered(m[0], new)
        letters += lettered
        found.append((m, new, lettered or len(new) == 1 and len(m[0]) == 2 and table[m[0][1]] < 0xA0 <= ord(m[0][1])))
    if all(weak for *_, weak in found) or 2 * letters >= len(found) or max(len(new) for _, new, _ in found) < least:
        return 0, text
    out, at = [], 0
    for m, new, _ in found:
        out += [text[at : m.start()], new]
        at = m.end()
    return sum(len(new) for _, new, _ in found), "".join(out) + text[at:]


def redecoded(text: str) -> str:
    """A text whose UTF-8 was read as another charset, once or several times, wholly or in parts, read anew: in each round the charset that explains most of it."""
    for _ in range(_ROUNDS):
        if text.isascii():
            return text
        n, new = max((_tried(text, name, least) for name, least in TAKEN_FOR), key=lambda x: x[0])
        if not n:
            return text
        text = new
    return text


def redecoded_text(c: Column) -> Column:
    """redecoded of each text; null stays null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(redecoded, na_action="ignore")

    return F.pandas_udf(run, "string")(c.cast("string"))
