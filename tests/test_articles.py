import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.functions import text as T
from lodestone.operators import articles as A
from lodestone.operators import chunking as C
from lodestone.operators import vectors as V

SF = "/root/testdata/sf0.001"
PAGE = """<!doctype html><html><head><meta property="og:title" content="Own title"><meta content='http://a/own' property='og:url'><title>t</title></head><body>
<nav><p>menu here</p></nav><p>outside</p>
<article><h1>Neck  pain</h1><p>alpha beta gamma delta<p>epsilon zeta eta theta
<h2>Signs</h2><ul><li>one two <ul><li>inner words here</li></ul></li><li>click me</li><li><p>three four</p></li></ul>
<blockquote><p>said the wise one</p></blockquote><p>after the quote</p>
<figure><img src="data:image/svg+xml,x" data-src="/a-300x200.jpg" alt="A" title="A"><figcaption>Source: Cap https://x.y -</figcaption></figure>
<img src="/loose.png"><p>tail words <img src="/b-40x400.png"><img srcset="/c.png 1x, /d.png 2x" width="90" height="90"></p>
<h2>References</h2><ol><li>Ref A</li><li>Ref B</li></ol>
<h2>More</h2><p>final words of it</p></article></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    rows = spark.createDataFrame([(1, "http://a/1", PAGE), (2, "http://a/2", ""), (3, "http://a/3", None)], "page_id long, url string, html string")
    return rows, H.blocks(rows)


def test_walk(page):
    got = [(r.tag, r.text, r.quoted) for r in page[1].orderBy("page_id", "pos").collect()]
    assert got == [
        ("h1", "Neck pain", False), ("p", "alpha beta gamma delta", False), ("p", "epsilon zeta eta theta", False), ("h2", "Signs", False),
        ("ul", "one two inner words here click me three four", False), ("ul", "inner words here", False), ("p", "three four", False),
        ("blockquote", "said the wise one", False), ("p", "said the wise one", True), ("p", "after the quote", False), ("figure", "Source: Cap https://x.y -", False),
        ("p", "tail words", False), ("h2", "References", False), ("ol", "Ref A Ref B", False), ("h2", "More", False), ("p", "final words of it", False),
    ]


def test_images(page):
    got = {r.tag: [tuple(i) for i in r.images] for r in page[1].where(F.size("images") > 0).collect()}
    assert got == {"figure": [("/a-300x200.jpg", "Cap", "A", "A", "Cap A")], "p": [("/c.png", "", "", "", "")]}


def test_articles_and_runs(page):
    pages, blocks = page
    got = {r.page_id: (r.title, r.references_text, r.references_count) for r in A.articles(pages, blocks).collect()}
    assert got == {1: ("Own title", "Ref A Ref B", 1), 2: ("", None, 0), 3: ("", None, 0)}
    assert [r.url for r in A.articles(pages, blocks).orderBy("page_id").collect()] == ["http://a/own", "http://a/2", "http://a/3"]
    runs = [(r.section, r.text, [i.src for i in r.images]) for r in A.runs(blocks, 1).orderBy("run").collect()]
    assert runs == [
        ("Neck pain", "alpha beta gamma delta epsilon zeta eta theta", []),
        ("Signs", "one two inner words here three four inner words here three four", []),
        ("Signs", "said the wise one", []),
        ("Signs", "after the quote tail words", ["/a-300x200.jpg", "/c.png"]),
        ("More", "final words of it", []),
    ]


def test_page_chunks(page):
    pages, blocks = page
    rows = A.page_chunks(pages, blocks, 1).orderBy("article_seq").collect()
    assert [r.article_seq for r in rows] == list(range(5))
    assert rows[3].embed_text == "Own title · Signs\n\nafter the quote tail words" and rows[3].text_with_images.endswith("tail words Cap A")
    assert len({r.chunk_id for r in rows}) == 5 and all(r.token_len <= 512 for r in rows)


def tokens(t):
    return math.floor(len(t.split()) / 0.75)


def brute(sentences, cap):
    most, units = math.ceil(0.75 * (cap + 1)) - 1, []
    for s in sentences:
        for c in [s] if tokens(s) <= cap else [p.strip() for p in re.split(r"(?<=[:;,—)-])\s+|(?<=\.)\s+(?=[A-Z0-9])", s) if p.strip()]:
            w = c.split()
            units += [c] if tokens(c) <= cap else [" ".join(w[i : i + most]) for i in range(0, len(w), most)]
    out, cur, n = [], "", 0
    for u in units:
        if cur and n + tokens(u) > cap:
            out, cur, n = [*out, cur], "", 0
        cur, n = (cur + " " + u if cur else u), n + tokens(u)
    return out + [cur] * bool(cur)


@pytest.mark.parametrize("cap", [8, 64, 512])
def test_hard_cap_against_python(spark, cap):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(T.sentences(F.col("text")).alias("s"))
    edge = spark.createDataFrame([([],), (["a, b " * 40, "c"],), (["w " * 600 + "end"],)], "s array<string>").select(F.transform("s", lambda x: F.trim(x)).alias("s"))
    for r in docs.unionByName(edge).select("s", C.hard_capped(F.col("s"), cap).alias("got")).collect():
        assert r.got == brute(r.s, cap)
        assert " ".join(r.got).split() == " ".join(r.s).split()  # nothing lost, order kept
        assert all(tokens(p) <= cap + len(p.split()) // 2 for p in r.got)


def test_chunk_order_is_gapless(spark):
    rows = C.chunks(spark.read.parquet(f"{SF}/documents.parquet"), cap=64).select("article_id", "article_seq", "chunk_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.article_id, []).append(r.article_seq)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_knn_over_a_grid(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "CELL", 30)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = e.where("vec_id % 9 = 0")
    rows = e.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    want = set()
    for r in q.collect():
        d = np.round(((x - np.array(r.embedding, float)) ** 2).sum(axis=1), 6)
        want |= {(r.vec_id, n + 1, int(ids[i])) for n, i in enumerate(np.lexsort((ids, d))[:5])}
    assert {(r.query_id, r.rank, r.id) for r in V.knn(q, e, 5).collect()} == want
    assert V.knn(q.limit(0), e, 5).count() == 0 and V.knn(q, e.limit(0), 5).count() == 0
