"""Held-out ranking of the quality classifier at a larger size, and links of clustered groups of embeddings."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from lodestone.llm import classifier, neighbors


def test_scores_rank_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()}
    rows = [r for r in classifier.query(spark, folder).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = (np.array([r["score"] for r in rows if labels[r["doc_id"]] == y]) for y in (1, 0))
    auc = np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad])
    right = np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows])
    print(f"{len(good)} good, {len(bad)} bad: AUC {auc:.4f}, accuracy {right:.4f}")
    assert len(bad) > 50 and auc >= 0.97 and right >= 0.95
    assert len({r["score"] for r in rows}) > len(rows) // 2


@pytest.mark.parametrize("scale", [1.0, 50.0, 1e4])
def test_calibration_reaches_the_least_loss(scale):
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 6)) * np.array([1, 1, scale, 1, 1 / scale, 1])
    y = (x[:, 0] + 0.3 * r.standard_normal(400) > 1.2).astype(float)
    weight = np.where(y > 0, 3.0, 0.5)
    w = classifier._logistic(x, y, weight)
    full = np.hstack([np.ones((400, 1)), x])
    p = 1 / (1 + np.exp(-full @ w))
    gradient = full.T @ (weight * (y - p)) - np.r_[1e-6, np.ones(6)] * w
    assert np.abs(gradient).max() < 1e-3 * weight.sum()


@pytest.mark.parametrize(("clusters", "share"), [(1, 0.9), (1, 0.85), (2, 0.85), (3, 0.88), (10, 0.8), (10, 0.9)])
def test_links_of_clustered_groups(spark, tmp_path, clusters, share):
    n, dim, window = 20_000, 64, 256
    r = np.random.default_rng(clusters)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centres, of = unit(r.standard_normal((clusters, dim))), r.integers(0, clusters, n)
    away = lambda v, c: unit(v - (v * c).sum(axis=1, keepdims=True) * c)
    rest = away(r.standard_normal((n, dim)), centres[of])
    k = n // 20
    close = 1 - (1 - r.uniform(0.931, 0.95, (k, 1))) / (1 - share)
    twin = close * rest[:k] + np.sqrt(1 - close**2) * away(away(r.standard_normal((k, dim)), centres[of[:k]]), rest[:k])
    rest[k : 2 * k], of[k : 2 * k] = away(twin, centres[of[:k]]), of[:k]
    x = (np.sqrt(share) * centres[of] + np.sqrt(1 - share) * rest).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x), "label": np.ones(n, np.int32)}), str(tmp_path / "e.parquet"), row_group_size=4096)
    got = {v.vec_id: v.component_id for v in neighbors.near_duplicates(spark.read.parquet(str(tmp_path / "e.parquet")), neighbors=window).select("vec_id", "component_id").collect()}
    x = unit(x.astype(float))
    links = [(i + at, j) for at in range(0, n, 2000) for i, j in zip(*np.nonzero(x[at : at + 2000] @ x.T >= 0.93)) if i + at < j]
    kept = sum(got[a] == got[b] for a, b in links)
    mean = x.mean(axis=0)
    passes = neighbors.passes_of(x[::78], mean, n, 0.93, window)
    print(f"{clusters} clusters, share {share}: {kept} of {len(links)} links, {passes} passes by the sample")
    assert len(links) >= k / 2 and kept >= 0.97 * len(links)


@pytest.mark.parametrize(("clusters", "copies"), [(0, 0), (3, 400)])
def test_links_of_a_group_whatever_its_size(spark, monkeypatch, clusters, copies):
    """The same rows in one large group of several sides and many blocks, and beside it pair by pair in groups of their own: every link, none more."""
    monkeypatch.setattr(neighbors, "SIDE", 32 * 1000)
    n, dim, k = 3000, 32, 300
    r = np.random.default_rng(21)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(r.standard_normal((n, dim)) + (3 * unit(r.standard_normal((clusters, dim)))[r.integers(0, clusters, n)] if clusters else 0))
    c, noise = r.uniform(0.9301, 0.94, (k, 1)), r.standard_normal((k, dim))
    x[k : 2 * k] = c * x[:k] + np.sqrt(1 - c**2) * unit(noise - (noise * x[:k]).sum(axis=1, keepdims=True) * x[:k])
    x[n - copies :] = unit(x[n - 1] + 0.05 * r.standard_normal((copies, dim)))
    x = x.astype(np.float32)
    rows = [(i, x[i].tolist(), -1) for i in range(n)] + [(n + i, x[i].tolist(), i % k) for i in range(2 * k)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    u = unit(x.astype(float))
    links = u @ u.T >= 0.93
    component = np.arange(n)
    while True:  # the least id among the linked, until it stays
        lower = np.where(links, component, n).min(axis=1)
        if (lower == component).all():
            break
        component = lower
    expected = {i: (links[i].sum() - 1, component[i]) for i in range(n)}
    expected |= {n + i: (int(links[i, (i + k) % (2 * k)]), n + i % k if links[i, (i + k) % (2 * k)] else n + i) for i in range(2 * k)}
    for window in (16, 2048):
        got = {v.vec_id: (v.n_links, v.component_id) for v in neighbors.near_duplicates(df, neighbors=window).collect()}
        assert len(got) == len(rows) and {i: (got[i], e) for i, e in expected.items() if got[i] != e} == {}


def test_a_cosine_at_the_similarity_has_one_answer():
    """Alone or among others, either way round, at any length, as the SQL's formula has it."""
    r = np.random.default_rng(5)
    u = r.standard_normal((500, 64)).astype(np.float32)
    v = (u + 0.4 * r.standard_normal((500, 64))).astype(np.float32)
    for i in range(0, 500, 25):
        a, b = u[i].astype(float).tolist(), v[i].astype(float).tolist()
        dot, norm = 0.0, []
        for w in (a, b):
            norm.append(0.0)
            for y in w:
                norm[-1] += y * y
        for y, z in zip(a, b):
            dot += y * z
        cosine = dot / (np.sqrt(norm[0]) * np.sqrt(norm[1]))
        for at, answer in ((cosine, True), (np.nextafter(cosine, 2), False)):
            many = neighbors._reached(u, v, at)[i]
            one = neighbors._reached(v[i : i + 1].astype(float) * 2.0**600, u[i : i + 1], at)[0]
            assert many == one == answer


def test_results_of_two_runs_stay(spark):
    folder = "/root/testdata/sf0.001"
    one = corpus_pipeline.run(spark, folder)
    n = one.count()
    two = corpus_pipeline.run(spark, folder)
    assert [two.count(), one.count(), two.count(), one.count()] == [n] * 4 and n > 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [corpus_pipeline.secret_scan(spark, docs, folder), corpus_pipeline.packed(spark, docs, folder)]
    counts = [d.count() for d in kept]
    again = [corpus_pipeline.secret_scan(spark, docs, folder), corpus_pipeline.packed(spark, docs, folder)]
    assert [d.count() for d in again] == counts == [d.count() for d in kept]
