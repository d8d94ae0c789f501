"""Plug-in points, stored tables and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking as C
from lodestone.operators import gold as G
from lodestone.operators import vectors as V
from lodestone.sources import npy, tables


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_neighbours_of_odd_vectors(spark, metric):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [nan, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [None, 1.0]), (6, []), (7, [0.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0]), (10, [inf, 1.0]), (None, [1.0, 0.0]), (11, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sound = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (metric == "l2sq" or any(v))}
    want = set()
    for i, q in sound.items():
        dist = sorted((round(float(((q - x) ** 2).sum() if metric == "l2sq" else 1 - q @ x), 5), j) for j, x in sound.items() if len(x) == len(q))
        want |= {(i, n + 1, j, d) for n, (d, j) in enumerate(dist[:2])}
    got = {(r.query_id, r.rank, r.id, round(r.dist, 5)) for r in V.knn(df, df, 2, metric=metric).collect()}
    assert got == want


def test_dedup_keeps_one_of_equal_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, " A  b", "x"), (1, "a b", "x"), (None, "a b", "x"), (2, None, "y"), (3, "", None)], "id long, t string, s string")
    got = C.dedup_near_exact(df, "t", ["s", "id"]).collect()
    assert sorted((r.id, r.s) for r in got) == [(1, "x"), (2, "y")]


def test_encoder_and_model(spark):
    def encoder():
        return lambda texts: np.array([[len(t), t.count("a") + 1.0] for t in texts])

    rows = spark.createDataFrame([(1, "banana"), (2, None), (3, " nan ")], "id long, text string")
    got = {r.id: r.embedding for r in V.encoded(rows, "text", encoder).collect()}
    for i, t in ((1, "banana"), (2, "[EMPTY]"), (3, "[EMPTY]")):
        x = np.array([len(t), t.count("a") + 1.0])
        assert np.allclose(got[i], x / np.linalg.norm(x))
    with pytest.raises(ValueError, match="no column body; there are id, text"):
        V.encoded(rows, "body", encoder)
    got = {r.id: r.reply for r in V.replied(rows, F.concat(F.lit("> "), "text"), lambda: lambda prompts: [f" {p.upper()} " for p in prompts]).collect()}
    assert got == {1: "> BANANA", 2: "", 3: ">  NAN"}


def test_build_and_save(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "b.html", 1, "two"), ("a", "b.html", 0, "one"), ("b", "a.html", 0, " ONE "), ("c", "c.html", 0, "two")], "article_id string, source_relpath string, article_seq int, body string")
    articles = spark.createDataFrame([("a", "u2"), ("b", "u1"), ("d", "u0")], "article_id string, url string")
    folder = str(tmp_path / "out")
    got_articles, got = tables.build_and_save(articles, chunks, folder)
    assert sorted((r.article_id, r.body) for r in got.collect()) == [("a", "two"), ("b", " ONE ")]
    assert sorted(r.article_id for r in got_articles.collect()) == ["a", "b"]
    with pytest.raises(Exception, match="(?i)exist"):
        tables.build_and_save(articles, chunks, folder)
    with pytest.raises(ValueError, match="no chunks"):
        tables.build_and_save(articles, chunks.limit(0), str(tmp_path / "none"))


def test_index_and_matrices(spark, tmp_path):
    docs = spark.createDataFrame([(1, "long enough " * 10, "s"), (2, "short", "s"), (3, "another text " * 10, None)], "doc_id long, text string, source string")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "doc_id long, embedding array<float>")
    path = str(tmp_path / "index")
    assert [(r.id, r.embedding) for r in tables.open_index(spark, path, docs, vectors, "doc_id", "text").collect()] == [("1", [1.0])]
    assert tables.create_index(docs, vectors, path, "doc_id", "text", overwrite=True) == 1
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float64).reshape(3, 2))
    assert {(r.row, tuple(r.vec)) for r in npy.read(spark, str(tmp_path / "m.npy")).collect()} == {(0, (0.0, 1.0)), (1, (2.0, 3.0)), (2, (4.0, 5.0))}


def test_topics_and_dangling_ids(spark):
    gold = spark.createDataFrame([(1, " q ", "", None), (2, "q", "own", "b"), (3, "z", " ", None)], "id long, question string, topic string, bucket string")
    known = spark.createDataFrame([("q", "t", "k"), ("q ", "u", "k")], "question string, topic string, bucket string")
    assert sorted((r.id, r.topic, r.bucket) for r in G.with_topics(gold, known).collect()) == [(1, "t", "k"), (2, "own", "b"), (3, "", "")]
    ids = spark.createDataFrame([(1, "a"), (1, "z"), (1, "z"), (2, None)], "key long, id string")
    assert [tuple(r) for r in G.dangling(ids, spark.createDataFrame([("a",)], "id string")).collect()] == [(1, "z")]
