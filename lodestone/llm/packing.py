"""Packing of tokenized documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import base64
import functools
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

WINDOW, END_ID = 2048, 1
TOKENIZER = "byte_bpe_50k"
BATCH = 256


def ranks_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


# Fixed value: the vocabulary's one special token, which a text can hold.
SPECIAL = {"<|endoftext|>": 50256}
_encodings: dict[str, object] = {}


def encoder(path: str):
    """Text to ids, by the byte-level BPE of a rank file: those of the same vocabulary's JSON file, whose merges have that order. Loaded once in a process."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return functools.partial(_encodings[path].encode, allowed_special="all")


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, nth bigint"


def _piece_rows(path: str, window: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)  # pieces of each length so far in this task
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.slice(at, BATCH)
                doc_id, start, length, crc, total, nth, ids = [], [], [], [], [], [], []
                for d, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                    tokens = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                    for s in range(0, len(tokens), window):
                        piece = tokens[s : s + window]
                        doc_id.append(d)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(tokens))
                        nth.append(int(seen[len(piece)]))
                        seen[len(piece)] += 1
                        if keep_ids:
                            ids.append(piece.astype(np.int32))
                cols = [pa.array(x, pa.int64()) for x in (doc_id, start, length, crc, total)] + [pa.array([task] * len(nth), pa.int32()), pa.array(nth, pa.int64())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"]
                if keep_ids:
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


class CapacityTree:
    """Which remaining capacities some open window has: a segment tree over 0..most, asked for the tightest one that fits."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.open = [0] * (2 * self.leaves)

    def set(self, capacity: int, some: bool) -> None:
        i = capacity + self.leaves
        self.open[i] = int(some)
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.leaves
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first, n, sequence, each, offset) of best-fit decreasing over counts[length] pieces.

    Pieces of a length are numbered; those from `first`, n of them, go `each` to
    a window, into windows counted from `sequence`, at `offset` and behind it.
    Equal windows are treated together: the work and the result depend on the
    number of lengths and capacities, not of pieces, and equal what one piece at
    a time gives, since a window that took a piece is the tightest for the next
    equal one as long as it fits.
    """
    tree, ranges, steps, sequences = CapacityTree(window), defaultdict(deque), [], 0
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        first, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            each = (capacity or window) // length
            need = -(-left // each)
            if capacity is None:
                capacity, begin, windows = window, sequences, need
                sequences += need
            else:
                begin, have = ranges[capacity].popleft()
                windows = min(have, need)
                if windows < have:
                    ranges[capacity].appendleft((begin + windows, have - windows))
                if not ranges[capacity]:
                    tree.set(capacity, False)
            n = min(left, windows * each)
            steps.append((length, first, n, begin, each, window - capacity))
            full, rest = divmod(n, each)
            for at, many, used in ((begin, full, each), (begin + full, 1, rest)):
                if used and many and capacity - used * length:
                    ranges[capacity - used * length].append((at, many))
                    tree.set(capacity - used * length, True)
            first, left = first + n, left - n
    return steps


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece of every row.

    A row is its token ids and an end id. The special token's string in a text
    is that token, as in the tokenizer's own file. What is longer than a window is first
    cut into full windows; best-fit decreasing then places the remainders.
    Tasks number their pieces of each length; the numbers of pieces by length,
    at most `window` of them, are all that the plan needs, and its steps say
    where each numbered piece goes. They don't grow with the table.

    Null text is empty: one piece, the end id. Null and repeated ids are kept,
    each row by itself. Other columns are ignored. Empty table: empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = _PIECES + (", ids array<int>" if keep_ids else "")
    pieces = stored(base.mapInArrow(_piece_rows(tokenizer or ranks_path(), window, keep_ids), schema), "pieces")
    by_task = stored(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # window rows at most
    steps = best_fit_decreasing(counts, window)
    plan = spark.createDataFrame(steps, "length bigint, first bigint, n bigint, sequence bigint, each bigint, at bigint")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base_nth = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(base_nth, ["length", "task"]).withColumn("nth", F.col("nth") + F.col("before"))
    # the plan has a bound of its own, from the numbers of lengths and capacities
    placed = numbered.join(F.broadcast(plan), (numbered.length == plan.length) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("first") + F.col("n"))).drop(plan.length)
    k = F.col("nth") - F.col("first")
    out = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.floor(k / F.col("each"))).cast("bigint").alias("sequence_id"), (F.col("at") + (k % F.col("each")) * F.col("length")).cast("bigint").alias("offset"), *(["ids"] if keep_ids else []))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
