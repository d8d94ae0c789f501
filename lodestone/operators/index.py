"""A stored vector index in cells around centres: exact search that skips cells by the triangle inequality, changed by id in versions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import QUERY_BLOCK, _nearest

#: Centres are fitted on at most SAMPLE vectors, in the order of a hash of the id; every vector is indexed. There are at most MOST_CELLS.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 2048, 8
#: Vectors of one part of a cell; larger cells have several, dealt by a hash of the id.
PART = 65536
#: Cells that a query looks into first, for a bound on its k-th distance.
FIRST = 2
_SLACK = 2e-6
_DATA = "id bigint, vec array<double>, away double, part int, version int, cell int"


def _sound(rows: DataFrame, id_col: str, vector_col: str, metric: str) -> DataFrame:
    """(id, vec) of rows with an id and a vector of finite components; unit vectors by cosine, so that distances between them rank as cosines do."""
    vec = F.col(vector_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & (F.exists(vec, lambda x: x != 0) if metric == "cosine" else F.size(vec) > 0) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"))
    if metric == "cosine":
        rows = rows.select("id", F.expr("transform(array(sqrt(aggregate(vec, 0D, (s, x) -> s + x * x))), n -> transform(vec, x -> x / n))[0]").alias("vec"))
    return rows


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T
    return np.sqrt(np.maximum(d, 0))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def centres_of(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spaced vectors of a sample; one without vectors stays."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        nearest = _distances(sample, centres).argmin(axis=1)
        for c in np.unique(nearest):
            centres[c] = sample[nearest == c].mean(axis=0)
    return np.unique(centres, axis=0)


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                d = _distances(_rows(part.column("vec"), centres.shape[1]), centres)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vec"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["id", "vec", "cell", "away"])

    return run


def _cells_of(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    return rows.mapInArrow(_assigned(centres), "id bigint, vec array<double>, cell int, away double")


def _write(rows: DataFrame, path: str, version: int) -> None:
    """The rows' cells as folders of one version, larger cells in parts."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / PART)).cast("int")).drop("_n")
    rows.repartition("cell", "part").write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/data/version={version}")


def _counted(rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))), "cell")  # a row for each of MOST_CELLS at most


def _described(spark: SparkSession, path: str, version: int) -> DataFrame:
    rows = spark.read.schema(_DATA).parquet(f"{path}/data/version={version}")
    return rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), (F.max("part") + 1).alias("parts")).select("cell", F.lit(version).alias("version"), "n", "radius", "parts")


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "l2sq", cells: int | None = None) -> int:
    """A new index at a path, which must not hold one; how many vectors it has.

    Every vector goes to its nearest centre. A cell is a folder; a manifest, written
    last, says which version's folder holds it, how many vectors, in how many parts
    and how far from the centre. Of a repeated id one vector stays, the smallest.
    Null ids and vectors that are null, empty, not finite, of another than the most
    frequent length (of equally frequent ones the greatest) or, by cosine, zero are left out.
    """
    spark = vectors.sparkSession
    rows = _sound(vectors, id_col, vector_col, metric)
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim, n = (lengths["d"], lengths["count"]) if lengths else (1, 0)
    rows = rows.where(F.size("vec") == dim).groupBy("id").agg(F.min("vec").alias("vec"))
    sample = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()], float).reshape(-1, dim)
    centres = centres_of(sample, cells or max(1, min(MOST_CELLS, round(n**0.5)))) if len(sample) else np.zeros((1, dim))
    spark.createDataFrame([(i, c.tolist(), metric) for i, c in enumerate(centres)], "cell int, centre array<double>, metric string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/centres")
    _write(_counted(_cells_of(rows, centres)), path, 0)
    cells_made = _described(spark, path, 0).collect()  # MOST_CELLS rows at most
    _committed(spark, path, 0, [tuple(r) for r in cells_made])
    return sum(r["n"] for r in cells_made)


def _committed(spark: SparkSession, path: str, version: int, cells: list[tuple]) -> None:
    """The manifest of a version, which makes it visible; a row for no cell says that it is there, even without cells."""
    rows = [(-1, version, 0, 0.0, 1), *cells]
    spark.createDataFrame(rows, "cell int, version int, n long, radius double, parts int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/at={version}")


class Index:
    """An index at a path: its centres and one version of its manifest, which are as large as the number of cells; the newest version unless one is named."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        centres = sorted(spark.read.parquet(f"{path}/centres").collect())
        self.centres, self.metric = np.array([r["centre"] for r in centres], float), centres[0]["metric"]
        manifests = spark.read.parquet(f"{path}/manifest")
        self.version = manifests.agg(F.max("at")).first()[0] if version is None else version
        self.manifest = {r["cell"]: r for r in manifests.where(F.col("at") == self.version).drop("at").collect() if r["cell"] >= 0}

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """(id, vec, cell, away, part) of some cells, or of all: only their folders are read."""
        chosen = [self.manifest[c] for c in (self.manifest if cells is None else cells) if c in self.manifest and self.manifest[c]["n"]]
        if not chosen:
            return self.spark.createDataFrame([], "id bigint, vec array<double>, cell int, away double, part int")
        by: dict[int, list[int]] = {}
        for r in chosen:
            by.setdefault(r["version"], []).append(r["cell"])
        wanted = F.lit(False)
        for v, cs in by.items():
            wanted = wanted | ((F.col("version") == v) & F.col("cell").isin(cs))
        return self.spark.read.schema(_DATA).parquet(f"{self.path}/data").where(wanted).select("id", "vec", "cell", "away", "part")

    def upsert(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> "Index":
        """The index with these vectors in place of those of equal ids; only cells that lose or get a vector are written anew. Of a repeated id one stays, as in `build`."""
        new = _sound(vectors, id_col, vector_col, self.metric).where(F.size("vec") == self.centres.shape[1]).groupBy("id").agg(F.min("vec").alias("vec"))
        return self._changed(_cells_of(new, self.centres).withColumn("part", F.lit(0)), vectors.select(F.col(id_col).cast("bigint").alias("id")))

    def remove(self, ids: DataFrame, id_col: str = "vec_id") -> "Index":
        """The index without some ids."""
        return self._changed(self.rows([]), ids.select(F.col(id_col).cast("bigint").alias("id")))

    def _changed(self, new: DataFrame, gone: DataFrame) -> "Index":
        gone = gone.where("id is not null").distinct()
        touched = sorted({r[0] for r in self.rows().join(gone, "id", "left_semi").select("cell").union(new.select("cell")).distinct().collect()})  # numbers of cells
        version = self.version + 1
        left = self.rows(touched).join(gone, "id", "left_anti").unionByName(new)
        _write(_counted(left.drop("part")), self.path, version)
        made = {r["cell"]: r for r in _described(self.spark, self.path, version).collect()} if touched else {}
        manifest = [tuple(made.get(c) or self.manifest[c]) for c in sorted({*self.manifest, *made}) if c in made or c not in touched]
        _committed(self.spark, self.path, version, manifest)
        return Index(self.spark, self.path, version)

    def _visits(self, first: bool, k: int):
        """(query, cell) pairs: the nearest cells, until they hold k vectors; or all others that can hold one nearer than the k-th so far."""
        names = np.array(sorted(c for c, r in self.manifest.items() if r["n"]), int)
        centres = self.centres[names] if len(names) else self.centres[:0]
        sizes, radii, parts = (np.array([self.manifest[c][f] for c in names]) for f in ("n", "radius", "parts"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 1024):
                    part = batch.slice(at, 1024)
                    if not len(names):
                        continue
                    d = _distances(_rows(part.column("vec"), centres.shape[1]), centres)
                    order = np.argsort(d, axis=1, kind="stable")
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    near = (before < k) | (np.arange(len(names)) < FIRST)
                    if not first:
                        edge = np.array([np.inf if e is None else e for e in part.column("edge").to_pylist()])
                        near = ~near & (np.take_along_axis(d - radii, order, axis=1) <= (edge + _SLACK)[:, None])
                    i, j = np.nonzero(near)
                    cell = order[i, j]
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(i)), part.column("vec").take(pa.array(i)), pa.array(names[cell].astype(np.int32)), pa.array(parts[cell].astype(np.int32))], names=["id", "vec", "cell", "parts"])

        return run

    def _found(self, queries: DataFrame, first: bool, k: int, blocks: int) -> tuple[DataFrame, list[int]]:
        visits = queries.mapInArrow(self._visits(first, k), "id bigint, vec array<double>, cell int, parts int")
        cells = sorted(r[0] for r in visits.select("cell").distinct().collect())  # numbers of cells
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        left = visits.select("id", "vec", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block.alias("block"))
        right = self.rows(cells).select("id", "vec", "cell", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        found = left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInArrow(_nearest(k, self.metric), "query_id bigint, id bigint, dist double")
        return found, cells

    def search(self, queries: DataFrame, k: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", read: dict | None = None) -> DataFrame:
        """(query_id, rank, id, dist): the k nearest vectors of every query, as `vectors.knn` has them, from the cells that can hold one.

        The nearest cells give a bound on a query's k-th distance; a cell whose
        centre is further away than the bound and its radius is skipped. Both passes
        read only the folders of cells that some query visits; `read` takes their
        numbers. dist is the squared distance, or one less the cosine, to six places.
        """
        q = _sound(queries, id_col, vector_col, self.metric).where(F.size("vec") == self.centres.shape[1])
        blocks = -(-q.count() // QUERY_BLOCK) or 1
        near, one = self._found(q, True, k, blocks)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
        near = near.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
        length = F.sqrt((F.max("dist") + 1e-6) * (2 if self.metric == "cosine" else 1))
        edge = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, length).alias("edge"))
        far, two = self._found(q.join(edge, "id", "left"), False, k, blocks)
        if read is not None:
            read |= {"first": one, "second": two, "of": len(self.manifest)}
        return near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")
