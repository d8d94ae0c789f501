"""Whitening against numpy on whole tables, and the eigenvalue search on matrices of many kinds."""

import numpy as np
import pytest

from lodestone.llm import davidson, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x int, component string, vector string"


def plain(vectors):
    """{row: (deviation, whitened by component)}, n, explained, of usable vectors, by numpy's eigh and Python's integers."""
    x = {i: np.floor(np.array(v, np.float32).astype(float) * 256) + 0 for i, v in enumerate(vectors) if v and None not in v and np.isfinite(np.array(v, float)).all() and np.abs(np.array(v, np.float32).astype(float) * 256).max() < 2**53}
    lengths = [len(v) for v in x.values()]
    most = max(set(lengths), key=lambda d: (lengths.count(d), d)) if lengths else 0
    x = {i: v for i, v in x.items() if len(v) == most}
    if not x:
        return {}, 0, []
    fit = sorted({tuple(map(int, v)) for v in x.values()})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array(fit, float) - np.array(s) / n
    v = c.T @ c / n
    e, u = (a[..., ::-1] for a in np.linalg.eigh(v))
    k = min(4, int((e > 1e-10 * max(e[0], 1e-300)).sum())) if e[0] > 0 else 0
    out = {i: (sum((n * int(a) - b) ** 2 for a, b in zip(w, s)), ((w - np.array(s) / n) @ u[:, :k]) / np.sqrt(e[:k])) for i, w in x.items()}
    return out, n, e[:k] / np.trace(v)


def held(got, vectors, ids=None):
    out, n, explained = plain(vectors)
    k = len(explained)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(by) == len(out) * k
    for j in range(k):
        rows = [by[(ids[i] if ids else i, j + 1)] for i in out]
        assert {r["n"] for r in rows} == {n} and [int(r["deviation"]) for r in rows] == [d for d, _ in out.values()]
        assert len({r["explained"] for r in rows}) == 1 and rows[0]["explained"] == pytest.approx(explained[j], rel=1e-9)
        a, b = np.array([r["whitened"] for r in rows]), np.array([w[j] for _, w in out.values()])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
        assert rows[0]["identity_error"] < 1e-9


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, 3, "c", "v") for i, v in enumerate(vectors)], SCHEMA)


def test_query_equals_numpy_on_the_table(spark):
    path = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    held(whitening.query(spark, path).collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_odd_vectors_and_copies(spark):
    r = np.random.default_rng(2)
    good = (r.standard_normal((150, 9)) * np.linspace(1, 3, 9)).astype(np.float32).tolist()
    odd = [None, [], [None] * 9, [1.0, None] * 4 + [2.0], [float("nan")] * 9, [float("inf")] + [0.0] * 8, [1e30] * 9, [1.0, 2.0], [-0.0] * 9, [0.001] * 9]
    vectors = good + odd + [good[0]] * 80
    held(whitening.whiten(table(spark, vectors)).collect(), vectors)


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[1.0], [2.0], [4.0]], [[1.0, 2.0, 3.0, 4.0, 5.0]] * 2 + [[0.0] * 5, [1.0] * 5], [[1e9, 5.0], [-1e9, 6.0], [3e8, -7.0], [2e12, 1e12]]])
def test_few_vectors_little_rank_and_large_entries(spark, vectors):
    held(whitening.whiten(table(spark, vectors)).collect(), vectors)


def test_partial_sums_add_up_on_the_cluster(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 8)
    monkeypatch.setattr(whitening, "DIRECT", 2)
    vectors = np.random.default_rng(4).standard_normal((120, 6)).astype(np.float32).tolist()
    held(whitening.whiten(table(spark, vectors).repartition(5)).collect(), vectors)


@pytest.mark.parametrize("dim,kind", [(1, "plain"), (3, "plain"), (40, "plain"), (300, "plain"), (50, "equal"), (60, "clustered"), (80, "low rank"), (120, "tiny"), (30, "zero")])
def test_search_reaches_double_precision(dim, kind):
    r = np.random.default_rng(dim)
    q, _ = np.linalg.qr(r.standard_normal((dim, dim)))
    e = {"equal": np.ones(dim), "clustered": 1 + 1e-7 * np.arange(dim), "low rank": np.r_[9.0, 5.0, np.zeros(dim - 2)], "tiny": 1e-12 * np.arange(dim), "zero": np.zeros(dim)}.get(kind, r.random(dim)) if dim > 2 else np.ones(dim)
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors, products = davidson.largest(lambda x: a @ x, dim, 4)
    k = min(4, dim)
    assert np.abs(values - np.sort(e)[::-1][:k]).max() <= 1e-13 * max(e.max(), 1e-300)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 1e-12 * max(e.max(), 1e-300)
    assert products < 400


def test_minres_solves_every_column():
    r = np.random.default_rng(7)
    a = r.standard_normal((30, 30))
    a = a + a.T
    b = np.column_stack([r.standard_normal((30, 3)), np.zeros(30)])
    x = davidson.minres(lambda v, at: a @ v, b, 200, 1e-12)
    assert np.abs(a @ x - b).max() < 1e-8
