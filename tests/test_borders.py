"""Learned sentence borders: planted abbreviations of several languages, and texts that lose nothing."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import borders

SHORT = {"en": ("Dr.", "approx.", "Fig.", "e.g."), "de": ("z.B.", "bzw.", "Nr.", "Prof."), "fr": ("env.", "cf.", "Mme."), "es": ("Sr.", "pág.", "aprox.")}


@pytest.fixture(scope="module")
def corpus(spark):
    """(texts of sentences with abbreviations before capitals, the sentences themselves) by language."""
    r = random.Random(8)
    rows, want = [], {}
    for lang, short in SHORT.items():
        words = ["".join(r.choice("abdegilmnorstuv") for _ in range(r.randrange(4, 10))) for _ in range(120)]
        for i in range(150):
            sentences = []
            for _ in range(r.randrange(1, 7)):
                w = [r.choice(words) for _ in range(r.randrange(4, 12))]
                if r.random() < 0.5:
                    w[2:2] = [r.choice(short), r.choice(words).capitalize()]
                if r.random() < 0.1:
                    w[1:1] = ["J.", "Smith"]
                begin = "However," if r.random() < 0.3 else w[0].capitalize()
                sentences.append(" ".join([begin, *w[1:]]) + r.choice(".....!?"))
            key = len(rows)
            want[key] = sentences
            rows.append((key, lang, " ".join(sentences)))
    rows.append((len(rows), "en", "However is never far. Dr. However"))
    return spark.createDataFrame(rows, "doc_id int, lang string, text string"), want


def test_planted_abbreviations_are_found(spark, corpus):
    docs, want = corpus
    known = borders.learned(docs, group_col="lang").collect()
    for lang, short in SHORT.items():
        found = {r["type"] for r in known if r["grp"] == lang and r["abbreviation"]}
        assert found - {"j"} == {s[:-1].lower() for s in short}
    assert {r["type"] for r in known if r["starter"]} == {"however"}


def test_sentences_end_where_they_were_joined(spark, corpus):
    docs, want = corpus
    known = borders.learned(docs, group_col="lang")
    got: dict[int, list] = {}
    for r in borders.sentences(docs, known, group_col="lang").orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["sentence"])
    right = sum(got[i] == s for i, s in want.items())
    assert right >= 0.99 * len(want)
    assert got[len(want)] == ["However is never far.", "Dr.", "However"]  # a known starter ends what an abbreviation holds


def test_odd_rows(spark):
    rows = [(1, None, None), (1, "en", ""), (None, "en", "A b. C d."), (2, "en", "  One. Two! (Three) four?  Five ... Six. \n Seven"), (2, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id int, lang string, text string")
    known = borders.learned(docs, group_col="lang")
    got = borders.sentences(docs, known, group_col="lang")
    assert sorted(r["sentence"] for r in got.where("doc_id = 2").collect()) == ["(Three) four?", "Five ...", "One.", "Seven", "Six.", "Two!", "x"]
    assert [r["sentence"] for r in got.where("doc_id is null").collect()] == ["A b. C d."] and got.where("doc_id = 1").count() == 0
    assert borders.sentences(docs.where("false"), known).count() == 0 == borders.learned(docs.where("false")).count()


def test_no_word_is_lost(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = borders.sentences(docs, borders.learned(docs, group_col="lang"), group_col="lang")
    squeezed = lambda c: F.regexp_replace(c, r"\s", "")
    whole = got.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("t"))
    both = docs.where(F.trim(F.regexp_replace("text", r"\s", "")) != "").join(whole, "doc_id", "left")
    assert both.where(~squeezed(F.col("text")).eqNullSafe(squeezed(F.col("t")))).count() == 0


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_texts_are_read_and_cut_into_words_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert final_plan(borders.learned(docs, group_col="lang")).count("FileScan") == 1


def test_closing_marks_before_an_odd_line_end_stay(spark):
    docs = spark.createDataFrame([("ab,\u2028 Cd ab. " * 20,)], "text string")
    assert {(r["type"], r["stop"]) for r in borders._tokens(docs, "text", F.lit("")).collect()} == {("ab,\u2028", False), ("cd", False), ("ab", True)}


def test_texts_move_whole_and_known_words_are_told_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = final_plan(borders.sentences(docs, borders.learned(docs, group_col="lang"), group_col="lang"))
    assert plan.count("FileScan") == 3 and "Window" not in plan  # for words, borders and sentences


def test_copies_and_odd_borders(spark):
    texts = ["A. B. C. D.", "Seen by Dr. Who? Yes. (No) by J. (K) .. X", "Ab. . Cd. \" Ef", "", "  ", None]
    docs = spark.createDataFrame([(k, t) for t in texts for k in (1, 1, None)], "doc_id int, text string")
    known = spark.createDataFrame([("", "dr", True, False), ("", "yes", False, True), ("", "c", True, False)], "grp string, type string, abbreviation boolean, starter boolean")
    got = sorted(map(str, ([r.doc_id, r.pos, r.sentence] for r in borders.sentences(docs, known).collect())))
    want = [["A. B. C. D."], ["Seen by Dr. Who?", "Yes.", "(No) by J. (K) ..", "X"], ["Ab. .", "Cd. \" Ef"]]
    assert got == sorted(str([k, i, s]) for ss in want for i, s in enumerate(ss) for k in (1, 1, None))
