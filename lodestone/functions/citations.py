"""Citations and bibliographic tails, one text at a time: the work grows with the text, since a year is looked for first and what stands before it is read backwards."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

# Number clusters, an author after a leading dash, what makes a parenthesis a citation, inline citations and tails, each in order.
NUMBER_CLUSTERS = (r"\b(?:\d+\s*,\s*)+\d+\b", r"\b(?:(?<!\d\d)(?<!\d\.)\d{1,2}\s+){1,6}\d{1,2}\b")
LETTERS = "ÅÄÖØÆËÉáàâäãåçéèêëíìîïñóòôöõúùûüÿćčžšß"
LEADING_AUTHOR = rf"^\s*[–\-]\s*[A-Z{LETTERS}][A-Za-z{LETTERS}]*(?:\s*&)?\s*"
PAREN_HINT = r"et al\.|doi|pmid|\b(?:19|20)\d{2}\b|[A-Z][a-z]+"
PAREN_REACH = 200
JOURNALS = ("Curr", "J", "Jour", "Journal", "Clin", "Arch", "Neurol", "Spine", "Orthop", "Otol", "Rheum", "Med", "Ther")
CITED_IN = ("J", "Jour", "Journal", "Spine", "Med", "Clin", "Rev", "Arch", "Neurol")
INLINE = (
    r"\bdoi\s*[:=]\s*\S+",
    r"\bpmid\s*[:=]\s*\d+",
    r"\bpmcid\s*[:=]\s*\S+",
    r"\(\s*[A-Z][a-z]+(?:\s+et\s+al\.)?,?\s*(?:,?\s*(?:19|20)\d{2})\s*\)",
    r"–\s*[A-Z][a-z]+(?:\s+et\s+al\.)?,?\s*(?:,?\s*(?:19|20)\d{2})",
    r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s*(?:et\s+al\.)?,?\s*(?:,?\s*(?:19|20)\d{2})",
    rf"\b({'|'.join(CITED_IN)})\.?[\sA-Z]*\d{{4}};?\s*\d*\(?.*?\)?[:;]?\d*[-–]?\d*",
    rf"\bReferences?:\s+[A-Z].{{0,160}}?\b(?:{'|'.join(JOURNALS)})\b[^\.]*?\d{{1,4}}[-–]\d{{1,4}}\.?",
)
TAILS = (
    r"(?:[A-Z][a-z]+(?:\s+[A-Z]\.){0,2},?\s*){2,}(?:19|20)\d{2}",
    r"(?:19|20)\d{2};\d+\(\d+\):\d+(?:-\d+)?",
    r"\b(et al\.|Elsevier|Springer|Wiley|Oxford|Lippincott)\b",
    r"–\s*[A-Z][a-z]+,\s*(?:19|20)\d{2}",
    r"\bReferences\b.*$",
    r"\s*\([^)]*?(?:19|20)\d{2}[^)]*?\)\s*$",
    r"\bReferences?:[^\.]{0,200}\.",
    r"\b[A-Z][a-z]{2,}\s(?:Opin|Orthop|Rheum|Neurol|Otol|Med|Ther)\b[^\.]*?\d{1,4}[-–]\d{1,4}\.?$",
)
TAIL_EDGE = " ,;.:–-"

_CLUSTERS = [re.compile(p) for p in NUMBER_CLUSTERS]
_AUTHOR, _HINT, _SPACES = re.compile(LEADING_AUTHOR), re.compile(PAREN_HINT, re.I), re.compile(r"\s{2,}")
_INLINE, _TAILS = [re.compile(p, re.I) for p in INLINE], [re.compile(p) for p in TAILS]
_NAMED, _JOURNAL, _LISTED = 5, 6, 7  # places in INLINE of words before a year, of a journal before four digits and of a list with pages
_AUTHORS, _LIST, _PAREN, _PAGES = 0, 4, 5, 7  # places in TAILS of authors before a year and of what has to end the text
_LIST_HEAD = re.compile(r"\bReferences?:(?=(\s+[A-Z]))", re.I)
_LIST_JOURNAL = re.compile(rf"\b(?:{'|'.join(JOURNALS)})\b", re.I)
_LIST_REACH = 160
_RANGE = re.compile(r"(?=\d{1,4}[-–]\d{1,4})")
_LAST_RANGE = re.compile(r"\d{1,4}[-–]\d{1,4}\.?$")
_PAGES_HEAD = re.compile(r"\b[A-Z][a-z]{2,}\s(?:Opin|Orthop|Rheum|Neurol|Otol|Med|Ther)\b")
_TAIL_YEAR = re.compile(r"(?:19|20)\d{2}")
_MARK = re.compile(r"(?:doi|pmc?id)\s*[:=]|\d{4}|References?:", re.I)
_YEAR, _FOUR = re.compile(r"(?=(?:19|20)\d{2})"), re.compile(r"(?<!\d)(?=\d{4})")
# The same things, read from their end.
_NAMES_BACK = re.compile(r"\s*,?\s*,?(?:\.la\s+te)?\s*[a-z]{2,}(?:\s+[a-z]{2,})*", re.I)
_RUN_BACK = re.compile(r"[\sA-Z]*", re.I)
_AUTHORS_BACK = re.compile(r"(?:\s*,?(?:\.[A-Z]\s+){0,2}[a-z]+[A-Z]){2,}")
_CITED = re.compile(rf"\b(?:{'|'.join(CITED_IN)})", re.I)
_CITED_BACK = re.compile(rf"(?:{'|'.join(w[::-1] for w in sorted(CITED_IN, key=len, reverse=True))})\b", re.I)
_NOISE = re.compile(r"[;:,&0-9\-\.\'\s]")


def _without_parens(text: str) -> str:
    """Parentheses with a hint of a citation and at most three characters besides digits, punctuation and spaces go."""
    out, at, i, close = [], 0, text.find("("), -1
    while i >= 0:
        if close < i:
            close = text.find(")", i)
        if close < 0:
            break
        hint = _HINT.search(text, i + 1, close)
        if not hint or hint.start() - i - 1 > PAREN_REACH:
            i = text.find("(", i + 1)
            continue
        if len(_NOISE.sub("", text[i + 1 : close])) <= 3:
            out.append(text[at:i])
            at = close + 1
        i = text.find("(", close + 1)
    return "".join(out) + text[at:]


def _named_starts(text: str, back: str) -> Iterator[tuple[int, int]]:
    """(where the words before a year begin, end of the year)."""
    for m in _YEAR.finditer(text):
        found = _NAMES_BACK.match(back, len(text) - m.start())
        if found:
            yield m.start() - (found.end() - found.start()), m.start() + 4


def _journal_starts(text: str, back: str) -> Iterator[tuple[int, int]]:
    """(where a journal's name before four digits begins, end of the digits)."""
    for m in _FOUR.finditer(text):
        found = _RUN_BACK.match(back, len(text) - m.start())
        run = m.start() - (found.end() - found.start())
        if run and text[run - 1] == ".":
            name = _CITED_BACK.match(back, len(text) - run + 1)
            if name:
                yield run - 1 - (name.end() - name.start()), m.start() + 4
                continue
        name = _CITED.search(text, run, m.start())
        if name:
            yield name.start(), m.start() + 4


def _listed_starts(text: str) -> Iterator[tuple[int, int]]:
    """(where a reference list begins that names a journal nearby and then, without a full stop between, pages; where the pages begin)."""
    heads = list(_LIST_HEAD.finditer(text))
    if not heads:
        return
    ranges, stops = [m.start() for m in _RANGE.finditer(text)], [m.start() for m in re.finditer(r"\.", text)]
    for m in heads:
        most = m.end(1) + _LIST_REACH
        line = text.find("\n", m.end(1), most)
        most = most if line < 0 else line
        for j in _LIST_JOURNAL.finditer(text, m.end(1), min(len(text), most + 8)):
            if j.start() > most:
                break
            r, stop = bisect_left(ranges, j.end()), bisect_left(stops, j.end())
            if r < len(ranges) and (stop == len(stops) or ranges[r] < stops[stop]):
                yield m.start(), ranges[r]
                break


def _without_inline(text: str) -> str:
    if not _MARK.search(text):
        return text
    back = text[::-1]
    found = {_NAMED: list(_named_starts(text, back)), _JOURNAL: list(_journal_starts(text, back)), _LISTED: list(_listed_starts(text))}
    place = dict.fromkeys(found, 0)
    ahead: dict[int, re.Match | None] = {}
    out, at = [], 0

    def following(k: int) -> re.Match | None:
        """The first match of a pattern from `at`."""
        if k not in found:
            return _INLINE[k].search(text, at)
        while place[k] < len(found[k]):
            start, end = found[k][place[k]]
            m = _INLINE[k].match(text, start) if start >= at else _INLINE[k].search(text, at, end) if end > at else None
            if m:
                return m
            place[k] += 1
        return None

    while True:
        for k in range(len(_INLINE)):
            if k not in ahead or (ahead[k] and ahead[k].start() < at):
                ahead[k] = following(k)
        some = [(m.start(), k) for k, m in ahead.items() if m]
        if not some:
            return "".join(out) + text[at:]
        start, k = min(some)
        out.append(text[at:start])
        at = ahead[k].end()


def without_citations(text: str) -> str:
    """Number clusters, an author after a leading dash, citing parentheses and inline citations go; white space is tidied."""
    for p in _CLUSTERS:
        text = p.sub("", text)
    text = _without_inline(_without_parens(_AUTHOR.sub("", text)))
    return _SPACES.sub(" ", text).strip()


def _last_paren(text: str) -> int | None:
    """Where a parenthesis with a year begins that ends the text, and the white space before it."""
    end = len(text.rstrip()) - 1
    if end < 0 or text[end] != ")":
        return None
    begin = text.find("(", text.rfind(")", 0, end) + 1, end)
    if begin < 0 or not _TAIL_YEAR.search(text, begin + 1, end):
        return None
    return len(text[:begin].rstrip())


def _last_list(text: str) -> int | None:
    """Where the word References stands in the last line."""
    line = text.rfind("\n", 0, len(text) - text.endswith("\n")) + 1
    m = re.compile(r"\bReferences\b").search(text, line)
    return m.start() if m else None


def _last_pages(text: str) -> int | None:
    """Where a journal's name begins behind which, without a full stop, pages end the text."""
    m = _LAST_RANGE.search(text, max(0, len(text) - 11))
    if not m:
        return None
    dash = re.compile("[-–]").search(text, m.start()).start()
    head = _PAGES_HEAD.search(text, text.rfind(".", 0, dash) + 1, dash)
    return head.start() if head and head.end() < dash else None


def _tail_start(text: str) -> int | None:
    starts = [m.start() for k, p in enumerate(_TAILS) if k not in (_AUTHORS, _LIST, _PAREN, _PAGES) and (m := p.search(text))]
    starts += [at for f in (_last_paren, _last_list, _last_pages) if (at := f(text)) is not None]
    back = text[::-1]
    for m in _YEAR.finditer(text):
        found = _AUTHORS_BACK.match(back, len(text) - m.start())
        if found:
            starts.append(m.start() - (found.end() - found.start()))
            break  # later years have later authors
    return min(starts, default=None)


def without_bibliography(text: str, min_words: int = 50) -> str:
    """The text up to the first bibliographic pattern; empty if under half of min_words are left; texts under 60 characters as they are."""
    if len(text) < 60:
        return text
    start = _tail_start(text)
    if start is not None:
        text = text[:start].rstrip(TAIL_EDGE)
    return text if len(text.split()) >= int(min_words * 0.5) else ""
