import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import gold as G
from lodestone.operators import retrieval as R
from lodestone.plans import catalog
from lodestone.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    a = entry.queries()[name](spark, SF).toPandas()
    b = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    a, b = (x[sorted(x.columns)].astype(str) for x in (a, b))
    assert sorted(map(tuple, a.values)) == sorted(map(tuple, b.values))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_budget_skips_and_headroom(spark):
    def picks(tokens):
        rows = [(1, i, i, 1, i / 10, "s", "x", t, "w") for i, t in enumerate(tokens)]
        items = spark.createDataFrame(rows, "query_id long, id long, flat_pos int, source_rank int, dist double, source string, section string, token_len int, text string")
        return [r.token_len for r in R.picked(items, budget=100, headroom=30).orderBy("pick_pos").collect()]

    assert picks([60, 50, 45]) == [60, 50]
    assert picks([60, 80, 20]) == [60, 20]


def test_memory_weights_keep_blank_turns(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "user", " "), (1, 3, "user", "c")], "conv_id long, turn long, role string, text string")
    got = R.ranked_memory(R.recent_turns(rows), F.lit(1.0)).collect()
    assert {r.turn: round(r.weight, 5) for r in got} == {1: 0.65, 3: 1.53846}


def test_gold_edits(spark):
    gold = spark.createDataFrame([("q", "T", ["c1"])], "id string, topic string, ids array<string>")
    edits = spark.createDataFrame([("q", " Manual ", [])], "id string, topic string, ids array<string>")
    assert tuple(G.merged(gold, edits, ["topic"], "ids").first()) == ("q", "T", [])
    log = spark.createDataFrame([(1, "q", "X"), (2, "q", None), (3, None, "z")], "line int, id string, topic string")
    assert [tuple(r) for r in G.last_edits(log, "id", ["line"]).select("id", "topic").collect()] == [("q", None)]
    a = lambda *x: F.array(*map(F.lit, x))
    row = spark.range(1).select(G.saved(a("a1"), a("b1", "a2"), a("a1", "a2")).alias("s"), G.removed(a("x", "y", "x"), a("x")).alias("r"), G.added(a("x"), a("y", "x")).alias("a")).first()
    assert (row.s, row.r, row.a) == (["a1", "b1"], ["y"], ["x", "y"])


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "a"}\nnot json\n')
    good, bad = tables.tolerant_json(spark, str(p), "id string")
    assert [r.id for r in good.collect()] == ["a"] and bad.count() == 1
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        tables.strict_json(spark, str(p), "id string").collect()


def test_versions_log_and_tables(spark, tmp_path):
    root = str(tmp_path / "gold")
    tables.save_version(spark.range(2), root, 1)
    tables.save_version(spark.range(5), root, 2)
    assert tables.latest_version(spark, root).count() == 5 and spark.read.parquet(root).where("version = 1").count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        tables.save_version(spark.range(1), root, 2)
    tables.save(spark.range(3), str(tmp_path / "b.parquet"))
    assert tables.table_or_none(spark, str(tmp_path), "a.parquet", "b.parquet").count() == 3
    assert tables.table_or_none(spark, str(tmp_path), "a.parquet", "c.jsonl") is None
    log = str(tmp_path / "log")
    for q in ("one", "two"):
        tables.log_answers(spark.createDataFrame([(q, 7)], "q string, prompt_tokens int"), log)
    got = spark.read.schema(tables.SESSION_RECORD).json(log).collect()
    assert sorted((r.q, r.prompt_tokens, r.answer) for r in got) == [("one", 7, None), ("two", 7, None)]


def test_question_numbers(spark):
    ids = "id long, question string, ids array<long>"
    rows = spark.createDataFrame([(i * 3 % 1009, f" q{i} ", [i, 1] if i % 2 else None) for i in range(1000)] + [(None, "x", [])], ids)
    got = sorted((r.number, r.id, r.question, r.first_id, r.n_ids) for r in G.question_table(rows, "id", "question", "ids").collect())
    want = sorted((i * 3 % 1009, f"q{i}", str(i) if i % 2 else "", 2 if i % 2 else 0) for i in range(1000))
    assert got == [(n + 1, *w) for n, w in enumerate(want)]
    assert G.question_table(rows.limit(0), "id", "question", "ids").count() == 0
