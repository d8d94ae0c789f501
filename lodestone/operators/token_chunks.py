"""Chunks measured by a tokenizer file: one pass over Arrow batches, in which every text is cut, measured and capped."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Texts of a batch that are measured together, and words whose counts a task keeps at most.
TOGETHER, KEPT = 64, 500_000
_SPACE = "[ \t\n\r\f\x0b]"
_SENTENCE = re.compile(rf"(?<=[.!?]){_SPACE}+(?=[A-Z(])")
_CLAUSE = re.compile(rf"(?<=[:;,—)-]){_SPACE}+|(?<=\.){_SPACE}+(?=[A-Z0-9])")
_COLUMNS = "article_id string, chunk_id string, title string, section string, chunk_idx string, article_seq int, embed_text string, body string, text_with_images string, images string, source_relpath string, token_len int, word_len int"


#: Unicode's white space with the word behind it; characters that Python and regular expressions elsewhere may not agree on.
_BLANK = "\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT, _UNSURE = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+"), re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")


class WordRule:
    """Tokens as words over 0.75, cut off."""

    def measure(self, texts: list[str]) -> list[int]:
        return [int(len(t.encode().split()) / 0.75) for t in texts]

    def runs(self, text: str, cap: int) -> list[str]:
        """The text's words in runs of at most cap tokens."""
        words = [w.decode() for w in text.encode().split()]
        most = max(-int(-(cap + 1) * 0.75 // 1) - 1, 1)
        return [" ".join(words[i : i + most]) for i in range(0, len(words), most)]

    def head(self, text: str, cap: int) -> str:
        return text


class Tokenizer:
    """Tokens by a tokenizer file at a path that every executor has."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer as File

        self.file = File.from_file(path)
        self.file.encode_special_tokens = True  # their strings in a text are ordinary text
        self.by_word, self.counts = self._adds_up(), {}

    def _adds_up(self) -> bool:
        """Whether a text's tokens are those of its words, each with the white space before it: the byte-level pattern takes no token across the end of a word."""
        rules = json.loads(self.file.to_str())
        cut = rules.get("pre_tokenizer") or {}
        plain = not any(rules.get(k) for k in ("normalizer", "truncation", "padding")) and all(t["special"] and not t["lstrip"] and not t["rstrip"] for t in rules.get("added_tokens") or [])
        return plain and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and rules["model"]["type"] == "BPE" and not rules["model"].get("dropout")

    def _units(self, text: str) -> list[str]:
        if _UNSURE.search(text):
            return [text]
        if " ".join(text.split()) == text:
            return text.replace(" ", "\x1c ").split("\x1c")
        return _UNIT.findall(text)

    def measure(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [len(e) for e in self.file.encode_batch(texts, add_special_tokens=False)]
        if len(self.counts) > KEPT:
            self.counts.clear()
        of, out, open_ = self.counts.__getitem__, [0] * len(texts), []
        for i, text in enumerate(texts):
            units = self._units(text)
            try:
                out[i] = sum(map(of, units))
            except KeyError:
                open_.append((i, units))
        new = [u for u in dict.fromkeys(itertools.chain.from_iterable(u for _, u in open_)) if u not in self.counts]
        self.counts.update(zip(new, map(len, self.file.encode_batch(new, add_special_tokens=False))))
        for i, units in open_:
            out[i] = sum(map(of, units))
        return out

    def runs(self, text: str, cap: int) -> list[str]:
        """The text's words in runs, each as long as cap allows; a word of more tokens is a run of its own."""
        words, out, at = [w.decode() for w in text.encode().split()], [], 0
        while at < len(words):
            some = words[at : at + cap]  # a word has a token at least
            ends = [end for _, end in self.file.encode(" ".join(some), add_special_tokens=False).offsets]
            length, n, place = 0, 0, 0
            for word in some:
                stop = place + len(word)
                while length < len(ends) and ends[length] <= stop:
                    length += 1
                if length > cap:
                    break
                n, place = n + 1, stop + 1
            n = max(n, 1)
            out.append(" ".join(some[:n]))
            at += n
        return out

    def head(self, text: str, cap: int) -> str:
        """The text up to the end of its first cap tokens, or a little less where that end lies in a character or the rest would be measured as more."""
        spans = self.file.encode(text, add_special_tokens=False).offsets
        n = cap
        while n > 0 and len(spans) > cap:
            cut = text[: spans[n - 1][1]]
            if spans[n][0] >= spans[n - 1][1] and len(self.file.encode(cut, add_special_tokens=False)) <= cap:
                return cut
            n -= 1
        return text if len(spans) <= cap else ""


@functools.lru_cache(1)
def _tokenizer(path: str, _changed: int) -> Tokenizer:
    """One for all tasks of a process, with the counts of words that it has seen."""
    return Tokenizer(path)


def split_sentences(text: str) -> list[str]:
    return [s for s in (p.strip(" ") for p in _SENTENCE.split(text)) if s]


def _grouped(sentences: list[str], cue: re.Pattern, most: int) -> list[str]:
    """Runs of sentences that a cue in one of two neighbours ties together, up to a number of words."""
    out: list[list[str]] = []
    size, tied = 0, False
    for s in sentences:
        n, now = len(s.encode().split()), cue.search(s) is not None
        if size and (now or tied) and size + n <= most:
            out[-1].append(s)
            size += n
        else:
            if out and not size:
                out.pop()
            out.append([s])
            size = n
        tied = now
    if out and not size:
        out.pop()
    return [" ".join(g) for g in out]


class Cutter:
    """Cuts texts by one measure, which is taken once for each different piece."""

    def __init__(self, measure: WordRule | Tokenizer):
        self.measure, self.known = measure, {}

    def learn(self, texts: list[str]) -> None:
        new = [t for t in dict.fromkeys(texts) if t not in self.known]
        self.known.update(zip(new, self.measure.measure(new)))

    def count(self, text: str) -> int:
        if text not in self.known:
            self.learn([text])
        return self.known[text]

    def capped(self, text: str, cap: int) -> list[str]:
        """A text packed into pieces of at most cap tokens by sentences, by clauses where one is longer, by words where a clause is."""
        parts: list[str] = []
        sentences = split_sentences(text)
        self.learn(sentences)
        for s in sentences:
            if self.count(s) <= cap:
                parts.append(s)
                continue
            for c in [c for c in (p.strip(" ") for p in _CLAUSE.split(s)) if c] or [s]:
                parts += [c] if self.count(c) <= cap else self.measure.runs(c, cap)
        out: list[list[str]] = []
        room = -1
        for p in filter(None, parts):
            n = self.count(p)
            if n <= room:
                out[-1].append(p)
                room -= n
            else:
                out.append([p])
                room = cap - n
        return [" ".join(p) for p in out]

    def overlapped(self, pieces: list[str], threshold: int) -> list[str]:
        """Each piece below a number of tokens behind the last sentence of the one before."""
        self.learn(pieces)
        lasts = [None, *((split_sentences(p) or [None])[-1] for p in pieces[:-1])]
        return [f"{last} {p}" if last is not None and self.count(p) < threshold else p for p, last in zip(pieces, lasts)]

    def resized(self, pieces: list[str], cap: int, threshold: int | None) -> list[str]:
        """Pieces over the cap packed anew."""
        self.learn(pieces)
        out: list[str] = []
        for p in pieces:
            if self.count(p) <= cap:
                out.append(p)
            else:
                cut = self.capped(p, cap)
                out += cut if threshold is None else self.overlapped(cut, threshold)
        return out


def _words(text: str) -> int:
    return len(text.encode().split())


def _pieces(cutter: Cutter, windows: list[str], head: str, cap: int, least: int, threshold: int) -> list[tuple[int, int, int, str]]:
    """(place, place inside, pieces there, text) of one block's chunks."""
    pieces = cutter.resized(windows, cap, threshold)
    long = [p for p in pieces if _words(p) >= least]
    forced = not long and bool(pieces)
    kept = cutter.resized([max(pieces, key=_words)] if forced else long, cap, None)
    cutter.learn([head + p for p in kept])
    room = max(cap - cutter.count(head), 1) if head else cap
    out = []
    for i, p in enumerate(kept):
        cut = [p] if cutter.count(head + p) <= cap else cutter.overlapped(cutter.capped(p, room), threshold)
        out += [(i, j, len(cut), x) for j, x in enumerate(cut) if x and (forced or _words(x) >= least)]
    return out


def _cut(tokenizer: str | None, cues: tuple[str, ...], cap: int, least: int, threshold: int, most_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _tokenizer(tokenizer, os.stat(tokenizer).st_mtime_ns) if tokenizer else WordRule()
        cue = re.compile(r"\b(" + "|".join(cues) + r")\b", re.IGNORECASE)
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                cutter, rows = Cutter(measure), batch.slice(at, TOGETHER).to_pylist()
                windows = []
                for r in rows:
                    groups = _grouped(split_sentences(r["text"]), cue, most_words)
                    windows.append([" ".join(groups[i : i + 6]) for i in range(0, len(groups), 4)])
                cutter.learn([w for ws in windows for w in ws])
                made = []
                for r, ws in zip(rows, windows):
                    head = r["header"] + "\n\n" if r["header"] and cutter.count(r["header"]) < cap else ""
                    found = _pieces(cutter, ws, head, cap, least, threshold)
                    cutter.learn([head + x for *_, x in found])
                    for nth, (i, j, n, body) in enumerate(found):
                        embed = head + body
                        if cutter.count(embed) > cap:
                            embed = measure.head(embed, cap)
                        made.append(
                            {
                                "article_id": r["article_id"], "chunk_id": hashlib.sha256(f"{r['article_id']}|{r['section'] or ''}|{i}_{j}|{body[:80]}".encode()).hexdigest(), "title": r["title"], "section": r["section"],
                                "chunk_idx": str(i) if n == 1 else f"{i}.{j}", "article_seq": nth, "embed_text": embed, "body": body, "text_with_images": " ".join([embed, *r["said"]]).strip(" "), "images": r["images"], "source_relpath": r["source_relpath"],
                                "token_len": cutter.count(embed), "word_len": _words(body), "_block": r["_block"],
                            }
                        )
                yield pa.RecordBatch.from_pylist(made, schema=_schema(batch.schema.field("_block").type))

    return run


def _schema(block: pa.DataType) -> pa.Schema:
    types = {"string": pa.string(), "int": pa.int32()}
    return pa.schema([*((n, types[t]) for n, t in (c.split() for c in _COLUMNS.split(", "))), ("_block", block)])


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", min_words: int = 50, cues=T.CAUSAL_CUES, cap: int = 512, title_col: str | None = None, section_col: str | None = None, block_col: str | None = None, images_col: str | None = None, tokenizer: str | None = None, threshold: int = 350, most_words: int = 350) -> DataFrame:
    """Chunks with the columns and rules of `chunking.chunks`, every count taken by a tokenizer file; by the words' rule without one.

    A piece's count is that of its own text, not a share of a larger one's, so
    token_len is exact. An embed_text that is still over the cap (behind an overlap, or
    with a word of more tokens) ends after its first `cap` tokens; body keeps all of it.
    Texts of an Arrow batch are measured together, each different piece once. Null
    text gives no chunk; long texts take time in proportion to their length.
    """
    least = max(50, int(min_words * 0.8))
    own = lambda name: F.col(name).cast("string") if name else F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    said = F.array_distinct(F.filter(F.transform(F.col(images_col), lambda i: F.trim(i["image_text"])), lambda x: x != "")) if images_col else none
    rows = docs.select(
        F.sha2(F.col(id_col).cast("string"), 256).alias("article_id"), F.col(source_col).cast("string").alias("source_relpath"), own(title_col).alias("title"), own(section_col).alias("section"), T.header(own(title_col), own(section_col)).alias("header"),
        (F.col(block_col) if block_col else F.lit(0)).alias("_block"), (F.to_json(images_col) if images_col else F.lit("[]")).alias("images"), F.coalesce(said, none).alias("said"), T.text_of(F.col(text_col)).alias("text"),
    )
    made = rows.mapInArrow(_cut(tokenizer, tuple(cues), cap, least, threshold, most_words), f"{_COLUMNS}, _block {rows.schema['_block'].dataType.simpleString()}")
    if block_col:
        made = made.withColumn("article_seq", F.row_number().over(Window.partitionBy("article_id").orderBy("_block", "article_seq")) - 1)
    return made.drop("_block")
