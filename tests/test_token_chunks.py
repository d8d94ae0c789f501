"""The chunker in Arrow batches against the one in Spark's expressions on whole tables, and its tokenizer's cuts."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, token_chunks
from lodestone.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("how", [{}, {"cap": 64, "title_col": "source", "section_col": "lang"}, {"cap": 20, "min_words": 5, "section_col": "lang"}])
def test_whole_table_by_the_words_rule(spark, how):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, other = (f(docs, cues=catalog.CUES, **how) for f in (chunking.chunks, token_chunks.chunks))
    assert one.schema.simpleString() == other.schema.simpleString()
    assert rows(one) == rows(other)


def test_blocks_and_images(spark):
    schema = "url string, text string, title string, section string, run int, images array<struct<src: string, caption: string, alt: string, title: string, image_text: string>>"
    prose = " ".join(f"Sentence {i} has some words and therefore a cue." for i in range(60))
    images = [("a", "", "", "", " said "), ("b", "", "", "", "said"), ("c", "", "", "", "more")]
    docs = spark.createDataFrame([("u", prose, "T", "S", 2, images), ("u", prose + " More.", " · ", None, 1, []), ("u", None, "T", "S", 3, images), ("v", "", None, None, None, None), ("w", "\x0b. A", None, "", 1, [])], schema)
    how = {"id_col": "url", "source_col": "url", "title_col": "title", "section_col": "section", "block_col": "run", "images_col": "images", "cap": 100}
    one, other = (f(docs, **how) for f in (chunking.chunks, token_chunks.chunks))
    assert rows(one) == rows(other) and one.count() > 4


def test_no_chunk_is_over_the_cap(spark, path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = spark.createDataFrame([(-1, "x" * 100_000, "en", "s", 1), (-2, "äöü€\U0001f600" * 5000, "en", "s", 1), (-3, "word " * 50_000, "en", "s", 1), (-4, "<|endoftext|> " * 900, "en", "s", 1)], docs.schema)
    measure = token_chunks.Tokenizer(path)
    for cap in (512, 40):
        got = token_chunks.chunks(docs.unionByName(long), cues=catalog.CUES, cap=cap, title_col="source", section_col="lang", tokenizer=path).collect()
        assert [r.token_len for r in got] == measure.measure([r.embed_text for r in got]) and max(r.token_len for r in got) <= cap
        whole = [r for r in got if r.embed_text.endswith(r.body)]
        assert len(whole) > (0.9 if cap == 512 else 0.3) * len(got)
        assert all((head := r.embed_text.partition("\n\n"))[1] and r.body.startswith(head[2]) for r in got if r not in whole)
        assert cap < 512 or {r.article_id for r in got} >= {r[0] for r in docs.where("size(split(text, ' ')) > 80").select(F.sha2(F.col("doc_id").cast("string"), 256)).collect()}


def test_pieces_lose_no_word(spark, path):
    r = random.Random(4)
    for measure in (token_chunks.WordRule(), token_chunks.Tokenizer(path)):
        for cap in (1, 7, 30):
            for _ in range(40):
                text = " ".join(r.choice(("one", "two,", "Three.", "éèê", "4.", "a-b;", "unbelievably", "(yes)", "Z" * 30)) for _ in range(r.randrange(0, 120)))
                pieces = token_chunks.Cutter(measure).capped(text, cap)
                assert " ".join(pieces).split() == text.split()
                counts = measure.measure(pieces)
                assert all(n <= 1.5 * cap + 1 or len(p.split()) == 1 for p, n in zip(pieces, counts))  # the parts' counts add up to the cap at most


def test_runs_are_as_long_as_the_cap_allows(path):
    measure, r = token_chunks.Tokenizer(path), random.Random(6)
    for _ in range(60):
        words = [r.choice(("the", "unbelievably", "x1y2", "€uro", "'s", "100,000", "Straße")) for _ in range(r.randrange(1, 80))]
        cap = r.choice((3, 8, 25))
        runs = measure.runs(" ".join(words), cap)
        assert " ".join(runs).split() == words
        for run, after in zip(runs, runs[1:]):
            assert measure.measure([run])[0] <= cap or len(run.split()) == 1
            assert measure.measure([run + " " + after.split()[0]])[0] > cap


def test_heads_end_at_the_cap(path):
    measure = token_chunks.Tokenizer(path)
    for text in ("one two three four", "äöü€" * 20, "\U0001f600" * 9, "x" * 200, "", "a"):
        for cap in (1, 2, 3, 10):
            head = measure.head(text, cap)
            assert text.startswith(head) and measure.measure([head])[0] <= cap
            assert head == text or measure.measure([text])[0] > cap


def test_groups_and_caps_of_the_whole_table(spark):
    import re

    import __spark_entry__ as entry

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    cue = re.compile(r"\b(" + "|".join(catalog.CUES) + r")\b", re.IGNORECASE)
    got: dict[int, list] = {}
    for r in entry.queries()["causal_groups"](spark, SF).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.grp)
    assert got == {i: g for i, t in texts.items() if (g := token_chunks._grouped(token_chunks.split_sentences(t), cue, 350))}
    got = {}
    for r in entry.queries()["hard_capped"](spark, SF).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.piece)
    assert got == {i: p for i, t in texts.items() if (p := token_chunks.Cutter(token_chunks.WordRule()).capped(t, 128))}


ODD = ["", " ", "a", " a", "a ", "a  b", "a\tb", "a\n\nThe end", "en\n\n\"Quote", "x\u00a0y \u00a0 z", "a\u2003 b\u2028", "a\x1cb \x1c!", "it's we'll  'll", "<|endoftext|> a <|endoftext|>b", "\u6f22\u5b57 \u304b\u306a\u3000x", "1 23 4.5,6", "!\x85!", "\U0001f600 \U0001f600\ufeff x", "a\u200bb \u180e", "e\u0301 \u0301", "\r\n a\r\n\r\nb \t\n", "tab\t b"]


def test_counts_by_words_are_the_file_s(spark, path):
    measure, r = token_chunks.Tokenizer(path), random.Random(3)
    made = ["".join(r.choice(["a", "Z", "'s", " ", "  ", "\n", "\t", "\u00a0", "\u2009", "7", ".", "\u00e9", "\u6f22", "\x1d", "\x85"]) for _ in range(r.randrange(1, 14))) for _ in range(5000)]
    texts = ODD + made + [x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    assert measure.by_word and measure.measure(texts) == [len(e) for e in measure.file.encode_batch(texts, add_special_tokens=False)]


def test_a_word_is_given_to_the_file_once(path):
    class Counted:
        def __init__(self, file):
            self.file, self.given = file, []

        def encode_batch(self, texts, **how):
            self.given += texts
            return self.file.encode_batch(texts, **how)

    measure = token_chunks.Tokenizer(path)
    measure.file = Counted(measure.file)
    for text in ("one two one", "two one two", "header\n\none two"):
        measure.measure([text] * 3)
    assert sorted(measure.file.given) == sorted([" one", " two", "\n\none", "header", "one", "two"])


def test_a_file_of_other_rules_counts_whole_texts(path, tmp_path):
    import json

    rules = json.loads(open(path).read())
    rules["normalizer"] = {"type": "Replace", "pattern": {"String": "a b"}, "content": "ab"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(rules))
    measure = token_chunks.Tokenizer(str(other))
    assert not measure.by_word and measure.measure(["a b", "x"]) == measure.measure(["ab", "x"])
