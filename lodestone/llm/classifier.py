"""Quality classifier by compression with dictionaries of good and bad texts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, DICTIONARY, LEVEL = 256, 1 << 16, 3
#: Labelled rows of each label for the dictionaries, as many whole texts as have so many bytes, and rows for the calibration.
DICTIONARY_ROWS, DICTIONARY_BYTES, CALIBRATION_ROWS = 2000, 16 << 20, 3000
N_DIFFERENCES = 4


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def _dictionary(chunks: list[bytes]) -> bytes:
    """Trained by zstandard; from too few texts for that, the texts themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, chunks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chunks)[-DICTIONARY:] or b"\n" * 8


class Sizes:
    """Compressed sizes of a text's chunks under both dictionaries, as features that don't depend on its length alone."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def features(self, text: bytes) -> tuple[float, ...]:
        """Compressed-size differences, bad less good: of the whole text by compressed size and by byte, and the least of a chunk by each. An empty text has none."""
        good, bad = self.pair
        total = spread = 0
        least, thin = math.inf, math.inf
        for at in range(0, len(text), CHUNK):
            part = text[at : at + CHUNK]
            g, b = len(good(part)), len(bad(part))
            total += max(g, b)
            spread += b - g
            if len(part) >= CHUNK // 2 or not at:
                least = min(least, (b - g) / max(g, b))
                thin = min(thin, (b - g) / len(part))
        return (spread / total, spread / len(text), least, thin) if text else (0.0,) * N_DIFFERENCES


def _features(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            rows = [sizes.features((t.as_py() or "").encode()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights with the least penalised loss, by Newton steps that are halved until the loss falls; the gradient says when it is done."""
    x = np.hstack([np.ones((len(x), 1)), x])
    sign = 2 * y - 1
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, -sign * (x @ w))).sum() + (penalty * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(200):
        p = np.exp(-np.logaddexp(0, -(x @ w)))
        gradient = x.T @ (weight * (y - p)) - penalty * w
        if np.abs(gradient).max() <= 1e-8 * weight.sum():
            return w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        size = 1.0
        while size > 1e-12 and loss(w + size * step) > now - 1e-4 * size * float(gradient @ step):
            size /= 2
        w = w + size * step
        if now - loss(w) <= 1e-14 * now:  # the loss can't be told from its least
            return w
        now = loss(w)
    raise ArithmeticError("the calibration did not converge")


def _expanded(x: np.ndarray) -> np.ndarray:
    """The differences and their products by pairs, so that the curve need not be straight."""
    return np.hstack([x, *(x[:, [i]] * x[:, i:] for i in range(x.shape[1]))])


_FLAT = (0.0,) * (1 + N_DIFFERENCES + N_DIFFERENCES * (N_DIFFERENCES + 1) // 2)
_UNFIT = ((0.0,) * N_DIFFERENCES, (1.0,) * N_DIFFERENCES, _FLAT)


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary_rows: int = DICTIONARY_ROWS, calibration_rows: int = CALIBRATION_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """A model from labelled(id, label 0/1): dictionaries from one bounded part of the rows of each label, in the order of a hash of the id, and the calibration from another.

    Whole texts go into a dictionary, as long as they have dictionary_bytes
    together. Calibration is logistic, on the whole texts' normalised
    compressed-size differences and on nothing else, weighted to the labels' own
    shares. Without rows of one label the scores are 0.5. Of an id's different labels the least counts.
    """
    known = labelled.where(F.col("label").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.col("label").cast("int")).alias("label"))
    share = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(share) < 2:
        return Model(b"\n" * 8, b"\n" * 8, *_UNFIT)
    h = F.xxhash64(id_col)
    of = lambda y, lo, n: known.where(F.col("label") == y).orderBy(h, id_col).offset(lo).limit(n)
    first = {y: min(dictionary_rows, (share[y] + 1) // 2) for y in (0, 1)}
    text = lambda ids: docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), id_col).select("label", h.alias("h"), "text")  # noqa: E731  a bounded number of ids
    learned = text(of(0, 0, first[0]).union(of(1, 0, first[1])))
    used, last = {0: 0, 1: 0}, {0: -(1 << 63), 1: -(1 << 63)}
    for y, place, n in sorted(map(tuple, learned.select("label", "h", F.coalesce(F.octet_length("text"), F.lit(0))).collect())):
        if used[y] and used[y] + n > dictionary_bytes:
            used[y] = dictionary_bytes + 1  # the order ends here
        else:
            used[y], last[y] = used[y] + n, place
    chosen = learned.where(F.col("h") <= F.when(F.col("label") == 0, last[0]).otherwise(last[1])).where("text is not null")
    chunks: dict[int, list[bytes]] = {0: [], 1: []}
    for y, _, t in sorted(map(tuple, chosen.collect())):
        raw = t.encode()
        chunks[y] += [raw[at : at + CHUNK] for at in range(0, len(raw), CHUNK)]
    good, bad = _dictionary(chunks[1]), _dictionary(chunks[0])
    rest = of(0, first[0], calibration_rows).union(of(1, first[1], calibration_rows))
    got = text(rest).select("label", "text").mapInArrow(_features(good, bad), "label int, x array<double>").collect()
    if len({r[0] for r in got}) < 2:
        return Model(good, bad, *_UNFIT)
    y, x = np.array([r[0] for r in got], float), np.array([r[1] for r in got])
    order = np.lexsort((*x.T, y))
    y, x = y[order], x[order]
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    each = np.array([share[0] / max(1, (y == 0).sum()), share[1] / max(1, (y == 1).sum())])
    weight = each[y.astype(int)]
    w = _logistic(_expanded((x - center) / scale), y, weight * len(y) / weight.sum())
    return Model(good, bad, tuple(center), tuple(scale), tuple(w))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, 0 to 1: higher where the whole text compresses better with the good texts' dictionary than with the bad ones'.

    Null text is empty and gets the score of an empty text. Null and repeated ids
    are kept, each row by itself. Other columns are ignored.
    """
    center, scale, w = np.array(model.center), np.array(model.scale), np.array(model.weights)
    good, bad = model.good, model.bad

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            if len(batch):
                x = np.array([sizes.features((t.as_py() or "").encode()) for t in batch.column("text")])
                z = w[0] + _expanded((x - center) / scale) @ w[1:]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id bigint, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = train(docs, labels.where(fold("doc_id") != 0))
    return score(docs, model).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
