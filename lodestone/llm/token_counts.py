"""Token counts that follow edits: a stored segment tree of pre-token runs for each text, re-encoded only where an edit touches it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import encoder, ranks_path
from .shared import stored

LEAF = 256
#: Where a pre-token begins whatever stands further away: a single space between two characters that aren't white space,
#: and punctuation behind a letter, except inside the special token's string.
_BREAK = regex.compile(r"(?<=\S) (?=\S)|(?<=\p{L})(?<!<\|endoftext)(?=\p{P})")
#: Characters around an edit that decide where pre-tokens begin: the special token's string can grow together over so many.
_MARGIN = 14


class TokenTree:
    """A text as leaves, each a run of whole pre-tokens of about LEAF characters, under a tree of their characters and tokens."""

    def __init__(self, text: str, encode, leaf: int = LEAF, chars: list[int] | None = None, tokens: list[int] | None = None):
        """A new tree, or a stored one of these leaves' characters and tokens, for which nothing is encoded."""
        self.encode, self.leaf, self.encoded = encode, leaf, 0
        if chars:
            ends = list(accumulate(chars))
            self._build([text[e - n : e] for n, e in zip(chars, ends)], tokens)
        else:
            self._build(self._leaves(text))

    def _leaves(self, text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > self.leaf:
            m = _BREAK.search(text, at + self.leaf)
            if not m:
                break
            out.append(text[at : m.start()])
            at = m.start()
        out.append(text[at:])
        return out

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.encode(text)) if text else 0

    def _build(self, leaves: list[str], tokens: list[int] | None = None) -> None:
        self.texts = leaves
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, t in enumerate(leaves):
            self.chars[self.size + i] = len(t)
            self.tokens[self.size + i] = self._count(t) if tokens is None else tokens[i]
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def find(self, char: int) -> tuple[int, int]:
        """(leaf, place in it) of a character; the end of the text is in the last leaf."""
        if char >= self.chars[1]:
            i = len(self.texts) - 1
            return i, char - self.chars[1] + len(self.texts[i])
        i = 1
        while i < self.size:
            i *= 2
            if char >= self.chars[i]:
                char -= self.chars[i]
                i += 1
        return i - self.size, char

    def _set(self, i: int, text: str) -> None:
        self.texts[i] = text
        i += self.size
        self.chars[i], self.tokens[i] = len(text), self._count(text)
        while i > 1:
            i >>= 1
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def replace(self, start: int, removed: int, inserted: str) -> None:
        """Put `inserted` in place of `removed` characters from `start`; both are cut to the text.

        The leaves it touches, and neighbours whose border it can move, become one
        run; that run alone is encoded again. A run that has grown to several
        leaves is split, and the tree over the leaves' sums is built anew.
        """
        start = min(max(start, 0), self.n_chars)
        stop = min(start + max(removed, 0), self.n_chars)
        lo, _ = self.find(max(start - _MARGIN, 0))
        hi, _ = self.find(min(stop + _MARGIN, self.n_chars))
        before = self._chars_before(lo)
        whole = "".join(self.texts[lo : hi + 1])
        whole = whole[: start - before] + inserted + whole[stop - before :]
        parts = self._leaves(whole)
        if len(parts) == 1:
            self._set(lo, whole)
            for i in range(lo + 1, hi + 1):
                self._set(i, "")
        else:
            tokens = [self.tokens[self.size + i] for i in range(len(self.texts))]
            new = [self._count(p) for p in parts]
            self._build(self.texts[:lo] + parts + self.texts[hi + 1 :], tokens[:lo] + new + tokens[hi + 1 :])

    def _chars_before(self, leaf: int) -> int:
        i, total = leaf + self.size, 0
        while i > 1:
            if i & 1:
                total += self.chars[i - 1]
            i >>= 1
        return total


_TREES = "doc_id bigint, key bigint, version int, n_tokens bigint, leaf_chars array<int>, leaf_tokens array<int>, chars_encoded bigint"
_EDITED = "doc_id bigint, text string, version int, n_tokens bigint, leaf_chars array<int>, leaf_tokens array<int>, chars_encoded bigint, n_edits bigint, n_tokens_before bigint"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(list(zip(*rows)) or [[]] * len(fields), fields)], names=[n for n, _ in fields])


def _leaves_of(tree: TokenTree) -> tuple[list[int], list[int]]:
    """Characters and tokens of the leaves that hold something."""
    held = range(tree.size, tree.size + len(tree.texts))
    return [tree.chars[i] for i in held if tree.chars[i]], [tree.tokens[i] for i in held if tree.chars[i]]


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, key, version, n_tokens, leaf_chars, leaf_tokens, chars_encoded) of every row: its segment tree as the leaves' characters and tokens, version 0.

    To be stored by document; key is a hash of the text. A null text is empty.
    Null and repeated ids are kept, each row by itself. Empty table: empty result.
    """
    path = tokenizer or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, key, text in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(), part.column("text")):
                    tree = TokenTree(text.as_py(), encode)
                    rows.append((doc_id, key, 0, tree.n_tokens, *_leaves_of(tree), tree.encoded))
                yield _rows(_TREES, rows)

    return _base(docs, id_col, text_col).mapInArrow(run, _TREES)


def edited(docs: DataFrame, table: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text, version, n_tokens, leaf_chars, leaf_tokens, chars_encoded, n_edits, n_tokens_before) of docs, whose stored trees are `table`, after edits(doc_id, edits).

    The result holds the new texts and, with their key, their trees: with
    stored_trees() it is the table for the next edits. chars_encoded are those of
    these edits.

    edits: array<struct<start, removed, inserted>>, one row for each document,
    applied in order, in characters of the text as the earlier ones left it;
    places beyond the text are cut to it, null numbers are 0 and null edits none.
    Trees are read back from their leaves; only the leaves that an edit touches
    are encoded. Rows of documents without edits stay as they are, with their
    version. Edits of a repeated id go to all its rows, those of a null id to none.
    Trees meet edits first, so texts are shuffled once. Every row of docs needs
    its tree in the table.
    """
    path = tokenizer or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, text, version, n, chars, tokens, changes in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "version", "n_tokens", "leaf_chars", "leaf_tokens", "edits"))):
                    changes = [c for c in changes or [] if c]
                    if not changes:
                        rows.append((doc_id, text, version, n, chars, tokens, 0, 0, n))
                        continue
                    tree = TokenTree(text, encode, chars=chars, tokens=tokens)
                    for c in changes:
                        tree.replace(c["start"] or 0, c["removed"] or 0, c["inserted"] or "")
                    rows.append((doc_id, tree.text, version + 1, tree.n_tokens, *_leaves_of(tree), tree.encoded, len(changes), n))
                yield _rows(_EDITED, rows)

    changes = edits.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("edits").cast("array<struct<start:int,removed:int,inserted:string>>").alias("edits")).where("doc_id is not null")
    kept = table.select("doc_id", "key", "version", "n_tokens", "leaf_chars", "leaf_tokens").dropDuplicates(["doc_id", "key"]).join(changes, "doc_id", "left")
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "version", "n_tokens", "leaf_chars", "leaf_tokens", "edits")
    base = _base(docs, id_col, text_col)
    rows = base.join(kept, base.doc_id.eqNullSafe(kept._id) & (base.key == kept._key)).select("doc_id", "text", "version", "n_tokens", "leaf_chars", "leaf_tokens", "edits")
    return rows.mapInArrow(run, _EDITED)


def stored_trees(result: DataFrame) -> DataFrame:
    """The trees of a stored result of edited(), as a table for the next."""
    return result.withColumn("key", F.xxhash64("text")).select(*[c.split()[0] for c in _TREES.split(", ")])


def derived_edits(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Three edits of every text that follow from the row: a word is put in, a stretch goes, and another is replaced by the row's source."""
    n = F.length(F.coalesce(F.col(text_col), F.lit("")))
    place = lambda salt: F.when(n > 0, F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), n)).otherwise(0).cast("int")
    edit = lambda start, removed, inserted: F.struct(start.alias("start"), F.lit(removed).alias("removed"), inserted.alias("inserted"))
    return F.array(edit(place(1), 0, F.concat(F.lit(" "), F.coalesce("lang", F.lit("")))), edit(place(2), 23, F.lit("")), edit(place(3), 7, F.coalesce("source", F.lit(""))))


def query(spark, sf_dir: str) -> DataFrame:
    """Trees of all documents, stored, and the counts after three edits of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = stored(trees(docs), "trees")
    edits = docs.where("doc_id is not null").select("doc_id", derived_edits().alias("edits")).groupBy("doc_id").agg(F.min("edits").alias("edits"))
    out = edited(docs, table, edits)
    return out.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_after"), F.length("text").cast("bigint").alias("n_chars_after"), F.col("chars_encoded").alias("chars_reencoded"), F.size("leaf_chars").alias("n_leaves"))
