"""Whitening of embeddings on the leading components of their covariance, found by Jacobi-Davidson without forming the matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .davidson import EPS, largest
from .shared import stored

SCALE, COMPONENTS, INNER = 256, 4, 6
#: Vectors of one stored block, blocks from which partial sums are added up on the cluster first, and the tasks that add them.
BLOCK, DIRECT, ADDERS = 1024, 256, 32
#: Entries whose scaled value reaches this are no exact doubles any more.
LIMIT = float(1 << 53)


@dataclass(frozen=True)
class Whitening:
    """n vectors of the fit list with exact sums, total variance, components as columns with their variances, and how far the whitened fit list is from unit covariance."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float


def _scaled(c: Column) -> Column:
    return c.cast("double") * SCALE


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, has entries, and only finite ones whose scaled value is exact, of the length that most of them have (of equally frequent ones the greatest)."""
    good = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(F.forall(vector, lambda c: F.coalesce(F.abs(_scaled(c)) < LIMIT, F.lit(False))))
    length = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.where(F.size(vector) == (length["d"] if length else 0))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole vectors, each in the narrowest integers that hold it."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.column("x").slice(at, BLOCK)
            flat = part.flatten().to_numpy()
            kind = np.result_type(np.min_scalar_type(min(0, int(flat.min()))), np.min_scalar_type(-int(flat.max()) - 1))
            yield pa.RecordBatch.from_arrays([pa.array([len(part)]), pa.array([kind.str]), pa.array([flat.astype(kind).tobytes()], pa.binary())], names=["n", "kind", "data"])


def fit_list(rows: DataFrame, vector: str) -> DataFrame:
    """Every different integer vector once, stored in blocks (n, kind, data)."""
    x = rows.select(F.transform(vector, lambda c: F.floor(_scaled(c)).cast("bigint")).alias("x")).distinct()
    return stored(x.mapInArrow(_packed, "n bigint, kind string, data binary"), "fit-list")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for v in batch.column("part"):
            part = np.frombuffer(v.as_py())
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])


def _sum_over(blocks: DataFrame, n: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of `of` over all blocks: one array a task, added up on the cluster where there are many, so that the driver gets at most DIRECT of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for rows, kind, data in zip(*(batch.column(c).to_pylist() for c in ("n", "kind", "data"))):
                part = of(np.frombuffer(data, kind).reshape(rows, -1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], names=["part"])

    parts = blocks.mapInArrow(run, "part binary")
    if n > DIRECT * BLOCK:
        parts = parts.repartition(ADDERS).mapInArrow(_added, "part binary")
    got = sorted(bytes(r[0]) for r in parts.collect())
    return sum(np.frombuffer(b) for b in got) if got else None


def _exact_sums(blocks: DataFrame) -> tuple[int, list[int]]:
    """(vectors, sums of each dimension) as whole numbers: high and low halves of the entries are added up apart, so that no sum is rounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, kind, data in zip(*(batch.column(c).to_pylist() for c in ("n", "kind", "data"))):
                x = np.frombuffer(data, kind).reshape(rows, -1).astype(np.int64)
                high, low = (x >> 24).sum(axis=0), (x & 0xFFFFFF).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(np.full(len(high), rows)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    got = blocks.mapInArrow(run, "i bigint, n bigint, high bigint, low bigint").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum("low").alias("low")).orderBy("i").collect()
    return (got[0]["n"] if got else 0), [(int(r["high"]) << 24) + r["low"] for r in got]


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, inner: int = INNER) -> Whitening | None:
    """Whitening by the different vectors of usable rows; None without any.

    A pass over the stored fit list gives the centred products of a block of
    vectors; the search works in the space of dimensions on the driver, whose
    size no row changes. Variances that are zero to double precision make no
    component.
    """
    blocks = fit_list(rows, vector)
    n, sums = _exact_sums(blocks)
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    dim = len(mean)
    trace = float(_sum_over(blocks, n, lambda x: ((x - mean) ** 2).sum(axis=0)).sum()) / n

    def product(q: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return _sum_over(blocks, n, of).reshape(dim, -1) / n

    values, vectors, _ = largest(product, dim, components, inner)
    some = values > 64 * dim * EPS * max(values[0], 0)
    values, vectors = values[some], vectors[:, some]
    if not len(values):
        return Whitening(n, tuple(sums), trace, values, vectors, 0.0)

    def squares(x: np.ndarray) -> np.ndarray:
        w = ((x - mean) @ vectors) / np.sqrt(values)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    s = _sum_over(blocks, n, squares) / n
    k = len(values)
    error = float(np.abs(s[k:].reshape(k, k) - np.outer(s[:k], s[:k]) - np.eye(k)).max())
    return Whitening(n, tuple(sums), trace, values, vectors, error)


def _whitened(model: Whitening):
    n, sums, mean = model.n, np.array(model.sums, object), np.array([s / model.n for s in model.sums])
    squared, most = int((sums * sums).sum()), max(abs(s) for s in model.sums)
    by = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                raw = part.column("vector")
                x = np.floor(raw.flatten().to_numpy().astype(np.float64).reshape(len(part), -1) * SCALE) + 0.0
                top, dim = int(np.abs(x).max()), x.shape[1]
                kind = np.int64 if dim * max(top, 1) * max(top, most) < 1 << 62 else object
                whole = x.astype(np.int64).astype(kind)
                own, cross = (whole * whole).sum(axis=1).tolist(), (whole * sums.astype(kind)).sum(axis=1).tolist()
                deviation = [str(n * n * a - 2 * n * b + squared) for a, b in zip(own, cross)]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(deviation), pa.array(list((x - mean) @ by), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return run


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, inner: int = INNER) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for every usable row and component.

    Entries are scaled by SCALE and rounded down. The fit list is each different
    vector once: n of them with sums S. deviation is the sum of (n * x - S)^2,
    a whole number as decimal(38,0); whitened is x - S / n on the component, over
    the square root of its variance. Components are numbered by falling variance,
    at most as many as the fit list has dimensions with any; without one there are no
    rows. Null vectors, empty ones, null, infinite or NaN entries, entries of
    2^53 / SCALE or more and lengths other than the most frequent one leave a row
    out. Repeated rows and null ids stay, other columns are ignored.
    """
    good = usable(rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector")), "vector")
    model = fit(good, "vector", components, inner)
    schema = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    each = good.mapInArrow(_whitened(model), "vec_id bigint, deviation string, whitened array<double>")
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    placed = each.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("whitened").alias("p", "whitened"))
    return placed.select("vec_id", (F.col("p") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(explained, F.col("p")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def query(spark, sf_dir: str) -> DataFrame:
    """The deviation as a long; null where it doesn't fit one."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").try_cast("bigint"))
