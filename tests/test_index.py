"""The stored index against exact search over everything, its pruning, and its versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import index, vectors

SCHEMA = "vec_id long, embedding array<float>, cell int, part int, id long"


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, 3) for i, v in enumerate(x)], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.select("query_id", "rank", "id", "dist").collect()))


def clustered(n, clusters, dim=16, seed=1):
    r = np.random.default_rng(seed)
    return (10 * r.standard_normal((clusters, dim)))[r.integers(0, clusters, n)] + r.standard_normal((n, dim))


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_search_equals_exact_search_and_skips_cells(spark, tmp_path, metric):
    x = clustered(3000, 40)
    if metric == "cosine":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = table(spark, x)
    assert index.build(df, str(tmp_path / "i"), metric=metric) == 3000
    read: dict = {}
    queries = df.where("vec_id % 500 = 0")
    got = rows(index.Index(spark, str(tmp_path / "i")).search(queries, 20, read=read))
    want = rows(vectors.knn(queries, df, 20, metric=metric))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)
    assert len(set(read["first"]) | set(read["second"])) < 0.6 * read["of"]  # six queries among forty clusters
    plan = index.Index(spark, str(tmp_path / "i")).rows(read["first"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "version" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_large_cells_have_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PART", 100)
    x = np.concatenate([clustered(400, 1, 4), np.zeros((300, 4))])
    df = table(spark, x)
    index.build(df, str(tmp_path / "i"), cells=3)
    at = index.Index(spark, str(tmp_path / "i"))
    assert max(r["parts"] for r in at.manifest.values()) > 2
    assert rows(at.search(df.where("vec_id % 50 = 0"), 7)) == rows(vectors.knn(df.where("vec_id % 50 = 0"), df, 7))


def test_versions_after_changes(spark, tmp_path):
    x = clustered(600, 12, seed=2)
    df = table(spark, x)
    path = str(tmp_path / "i")
    index.build(df, path)
    queries, before = df.where("vec_id % 60 = 0"), index.Index(spark, path)
    first = rows(before.search(queries, 10))
    moved = clustered(80, 12, seed=3)
    new = table(spark, [*moved[:50], None, [None] * 16, [1.0, 2.0], *moved[50:]], 570)  # ids of the index and others; odd vectors take theirs out
    after = before.upsert(new)
    kept = df.where("vec_id < 570").unionByName(new.where("embedding is not null and size(embedding) = 16 and forall(embedding, c -> c is not null)"))
    assert rows(after.search(queries, 10)) == rows(vectors.knn(queries, kept, 10))
    assert {r["version"] for r in after.manifest.values()} == {0, 1}  # cells that nothing touched are not written anew
    last = after.remove(df.where("vec_id % 2 = 0"))
    assert rows(last.search(queries, 10)) == rows(vectors.knn(queries, kept.where("vec_id % 2 = 1 or vec_id >= 600"), 10))
    assert rows(before.search(queries, 10)) == first == rows(index.Index(spark, path, 0).search(queries, 10))
    assert index.Index(spark, path).version == 2
    assert rows(last.remove(df.where("false")).search(queries, 10)) == rows(last.search(queries, 10))


def test_odd_and_few_vectors(spark, tmp_path):
    nan = float("nan")
    odd = [[1.0, 2.0], [1.0, 2.0], None, [None, 1.0], [nan, 1.0], [], [3.0], [0.0, 0.0], [5.0, 5.0]]
    df = table(spark, odd).unionByName(table(spark, [[9.0, 9.0]]).withColumn("vec_id", F.lit(None).cast("long"))).unionByName(table(spark, [[7.0, 7.0], [0.5, 7.0]]).withColumn("vec_id", F.lit(8).cast("long")))
    assert index.build(df, str(tmp_path / "i")) == 4  # of the vectors with id 8 the smallest
    got = index.Index(spark, str(tmp_path / "i")).search(df.where("vec_id < 2"), 10).collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == [(q, i) for q in (0, 1) for i in (0, 1, 7, 8)]
    assert {r["dist"] for r in got if r["id"] == 8} == {25.25}
    assert index.build(df.where("false"), str(tmp_path / "none")) == 0
    assert index.Index(spark, str(tmp_path / "none")).search(df.where("vec_id < 2"), 10).count() == 0
    empty = index.Index(spark, str(tmp_path / "i")).remove(df)
    assert empty.version == 1 and index.Index(spark, str(tmp_path / "i")).search(df, 3).count() == 0
    with pytest.raises(Exception, match="exists"):
        index.build(df, str(tmp_path / "i"))
