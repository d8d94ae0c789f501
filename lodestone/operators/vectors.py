"""Vectors: norms, distances, exact nearest neighbours in blocks of queries, differences of two sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

QUERY_BLOCK, CELL = 16384, 65536


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column, least: float = 1e-12) -> Column:
    """v over its norm, which is taken once for all components."""
    return T.once(F.greatest(norm(v), F.lit(least)), lambda n: F.transform(v.cast("array<double>"), lambda x: x / n))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    vec = table.column("vec").combine_chunks()
    return table.column("id").to_numpy(), vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), -1)


def _sizes(table: pa.Table) -> np.ndarray:
    return np.diff(table.column("vec").combine_chunks().offsets.to_numpy()) if len(table) else np.zeros(0, np.int32)


def _nearest(k: int, metric: str):
    """The k nearest of one cell of the corpus for each query of one block: products find the candidates, exact distances rank them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        have, sizes = _sizes(left), _sizes(right)
        for size in np.intersect1d(have, sizes):  # only vectors of one length have a distance
            (ids, q), (names, x) = _matrix(left.filter(pa.array(have == size))), _matrix(right.filter(pa.array(sizes == size)))
            xx, n = (x * x).sum(axis=1), min(k, len(x))
            for at in range(0, len(q), 128):
                part = q[at : at + 128]
                d = (part * part).sum(axis=1)[:, None] + xx - 2 * part @ x.T if metric == "l2sq" else 1 - part @ x.T
                slack = 2e-6 + 1e-12 * (xx.max() + (part * part).sum(axis=1))
                edge = np.partition(d, n - 1, axis=1)[:, n - 1] + slack
                for i, row in enumerate(d):
                    near = np.flatnonzero(row <= edge[i])
                    exact = np.round(((part[i] - x[near]) ** 2).sum(axis=1) if metric == "l2sq" else 1 - x[near] @ part[i], 6)
                    order = np.lexsort((names[near], exact))[:k]
                    out.append((np.full(len(order), ids[at + i]), names[near][order], exact[order]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "dist": pa.array(cols[2], pa.float64())})

    return run


def knn(queries: DataFrame, corpus: DataFrame, k: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "l2sq") -> DataFrame:
    """(query_id, rank, id, dist): the k nearest of corpus for every query, exactly; dist to six places, ties by id.

    Both sides are dealt to a grid of blocks of about QUERY_BLOCK queries and cells
    of about CELL vectors; a task holds one block and one cell. Nothing but the two
    counts comes to the driver, and k rows of each query and cell are shuffled.
    Vectors that are null, empty or hold null or non-finite components, and rows
    with a null id, are left out on both sides; so are zero vectors by cosine.
    Vectors of different lengths are never neighbours: a query can have fewer than
    k. A repeated id of the corpus is a row of its own; queries' ids must differ.
    """
    spark = corpus.sparkSession

    def side(df: DataFrame) -> DataFrame:
        vec = F.col(vector_col)
        finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        sound = finite & (F.exists(vec, lambda x: x != 0) if metric != "l2sq" else (F.size(vec) > 0))
        return df.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"))

    q, c = side(queries), side(corpus)
    blocks = -(-q.count() // QUERY_BLOCK) or 1
    cells = max(-(-c.count() // CELL), spark.sparkContext.defaultParallelism)
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("id", "vec", dealt(blocks).alias("block"), every(cells).alias("cell")).groupBy("block", "cell")
    right = c.select("id", "vec", dealt(cells).alias("cell"), every(blocks).alias("block")).groupBy("block", "cell")
    found = left.cogroup(right).applyInArrow(_nearest(k, metric), "query_id bigint, id bigint, dist double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")


def difference(a: DataFrame, b: DataFrame, key: str, vector_col: str = "embedding") -> DataFrame:
    """(key, cos_sim, l2_dist) of two vector sets joined on the key; a zero vector has norm 1."""
    left, right = a.select(key, F.col(vector_col).alias("u")), b.select(key, F.col(vector_col).alias("v"))
    safe = lambda c: F.when(norm(F.col(c)) == 0, 1.0).otherwise(norm(F.col(c)))
    both = left.join(right, key).withColumn("nu", safe("u")).withColumn("nv", safe("v"))
    cos = dot(F.col("u"), F.col("v")) / (F.col("nu") * F.col("nv"))
    return both.select(key, F.round(cos, 6).alias("cos_sim"), F.round(F.sqrt(F.greatest(2 - 2 * cos, F.lit(0.0))), 4).alias("l2_dist"))


def alignment(rows: DataFrame, vectors: DataFrame, row_key: str, vector_key: str) -> DataFrame:
    """(matched, rows_without_vector, vectors_without_row)."""
    r, v = rows.select(F.col(row_key).alias("k"), F.lit(1).alias("r")), vectors.select(F.col(vector_key).alias("k"), F.lit(1).alias("v"))
    both = r.join(v, "k", "full")
    n = lambda c: F.count_if(c).cast("bigint")
    return both.agg(n(F.col("r").isNotNull() & F.col("v").isNotNull()).alias("matched"), n(F.col("v").isNull()).alias("rows_without_vector"), n(F.col("r").isNull()).alias("vectors_without_row"))


def encoded(rows: DataFrame, text_col: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "embedding") -> DataFrame:
    """rows with a unit vector of each text, empty ones as "[EMPTY]": the place where a model goes.

    `encoder` is called once in a task and gives a function from texts to a
    matrix of one row for each; questions go through the same one.
    """
    if text_col not in rows.columns:
        raise ValueError(f"no column {text_col}; there are {', '.join(rows.columns)}")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for s in batches:
            x = np.asarray(encode(s.tolist()), np.float64).reshape(len(s), -1)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(x.astype(np.float32)))

    return rows.withColumn(out, F.pandas_udf(run, "array<float>")(T.sanitized(F.col(text_col))))


def replied(rows: DataFrame, prompt: Column, model: Callable[[], Callable[[list[str]], list[str]]], out: str = "reply") -> DataFrame:
    """rows with a model's reply to each prompt, trimmed: for classifiers, rewriters, scorers and generators. `model` is called once in a task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = model()
        for s in batches:
            yield pd.Series([(x or "").strip() for x in ask(s.tolist())])

    return rows.withColumn(out, F.pandas_udf(run, "string")(T.text_of(prompt)))
