"""Looks for tables and pages, strict records, and small writers."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import gold, quality
from lodestone.sources import paths, tables


def test_chunks_are_found_by_folder_and_suffix(spark, tmp_path):
    (tmp_path / "a").mkdir()
    with pytest.raises(FileNotFoundError, match="chunks.parquet, .*chunks.jsonl"):
        paths.chunks_path(spark, str(tmp_path / "a"))
    (tmp_path / "a" / "chunks.jsonl").write_text('{"x": 1}\n')
    for asked in ("a", "a/chunks.jsonl", "a/chunks.parquet"):
        assert paths.chunks_path(spark, str(tmp_path / asked)).endswith("a/chunks.jsonl")
    tables.save(spark.range(3), str(tmp_path / "a" / "chunks.parquet"))
    for asked in ("a", "a/chunks.parquet"):
        assert paths.chunks_path(spark, f"file://{tmp_path}/{asked}").endswith("a/chunks.parquet")
    with pytest.raises(FileNotFoundError):
        paths.chunks_path(spark, str(tmp_path / "b.parquet"))


def test_search_upwards(spark, tmp_path, monkeypatch):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "two.jsonl").write_text("{}")
    (tmp_path / "one.jsonl").write_text("{}")
    find = lambda: paths.upwards(spark, str(tmp_path / "a" / "b"), ("one.jsonl", "two.jsonl"), "LODESTONE_TEST_CHUNKS")
    assert find().endswith("/a/two.jsonl")
    monkeypatch.setenv("LODESTONE_TEST_CHUNKS", str(tmp_path / "one.jsonl"))
    assert find() == str(tmp_path / "one.jsonl")
    assert paths.upwards(spark, str(tmp_path), ("no such name",)) is None


def test_site_roots(spark, tmp_path):
    for n in ("feed/pages", "feed/other"):
        (tmp_path / n).mkdir(parents=True)
    assert paths.site_root(spark, str(tmp_path)) == str(tmp_path)
    (tmp_path / "site").mkdir()
    (tmp_path / "site" / "index.html").write_text("<html><p>x</p></html>")
    assert paths.site_root(spark, str(tmp_path)) == str(tmp_path)


def test_strict_records(spark, tmp_path):
    assert tables.strict_json(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n   \n{"a": 2}\n')
    assert sorted(r.a for r in tables.strict_json(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        tables.strict_json(spark, str(tmp_path / "b.jsonl"), "a int").collect()


def test_small_writers_and_lists(spark, tmp_path):
    log = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, n int")
    tables.save_csv(tables.without_id(log, "id", "a"), str(tmp_path / "c"))
    assert sorted((r.id, r.n) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect() if r.id) == [("b", "2")]
    lists = spark.createDataFrame([([1, 2],), ([],), (None,)], "ids array<int>").select(T.texts_of_ids(F.col("ids")).alias("x")).collect()
    assert [r.x for r in lists] == [["1", "2"], [], []]


def test_facets_previews_and_counts(spark):
    rows = spark.createDataFrame([(1, "b", None, "x" * 200), (2, "a", "", " NaN "), (3, " ", "s", None), (4, "b", "s", "1, 2, 3 then")], "id int, topic string, source string, text string")
    got = quality.facet_values(rows, ["topic", "source"], ("source",)).collect()
    assert [(r.facet, r.value) for r in got] == [("source", ""), ("source", "s"), ("topic", "a"), ("topic", "b")]
    assert tuple(quality.empty_count(rows, "text").first()) == (4, 2) and tuple(quality.empty_count(rows.limit(0), "text").first()) == (0, 0)
    assert [r.id for r in quality.odd_head(rows, "text", ["id"]).collect()] == [4]
    assert {r.name: r.value for r in quality.preview(rows, ["id"], 5).collect()} == {"id": "1", "topic": "b", "source": None, "text": "xxxxx"}
    assert [r.id for r in gold.of_article(rows, "source", "s", ["id"]).collect()] == [3, 4]
