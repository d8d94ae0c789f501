from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.functions import scoring as S
from lodestone.functions import text as T
from lodestone.operators import chunking as C
from lodestone.operators import vectors as V
from lodestone.sources import tables


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


def test_token_rules(spark):
    fifty = " ".join(["w"] * 50)
    assert one(spark, fifty, T.chunk_tokens) == 66
    assert one(spark, fifty, T.query_tokens) == 66  # 66.5, half to even
    assert one(spark, None, T.chunk_tokens) == 0


def test_word_count_is_the_number_of_words(spark):
    for text in ("", " ", " \t\n\x0b\f\r", "a", " a", "a ", "\n a\tb \x0b c\f", "a\u00a0b c\u2003d", "\u00a0", None):
        assert one(spark, text, T.word_count) == one(spark, text, lambda c: F.size(T.words(c))) == len((text or "").encode().split())


def test_bytes_are_decoded(spark, tmp_path):
    page = "<!doctype html><html><body><p>é – ü</p></body></html>"
    for name, raw in {"index1": page.encode(), "index2": page.replace("–", "-").encode("latin-1"), "index3": b"\xef\xbb\xbf" + page.encode(), "index4": b"", "index5": b"\xff\xfe no page"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rpartition("/")[2]: r.html for r in tables.html_files(spark, str(tmp_path)).collect()}
    assert got == {"index1": page, "index2": page.replace("–", "-"), "index3": page}
    assert one(spark, None, tables.decoded, "binary") is None


def test_first_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, text = Tokenizer.from_file(path), "The quick brown fox, 1234 times; jumps\nover é the lazy dog."
    ids = t.encode(text, add_special_tokens=False).ids
    for most in (0, 1, 3, 7, len(ids), 1000):
        got = one(spark, text, lambda c: T.first_tokens(c, most, path))
        assert text.startswith(got) and got == t.decode(ids[:most])
    assert one(spark, None, lambda c: T.first_tokens(c, 3, path)) is None and one(spark, "", lambda c: T.first_tokens(c, 3, path)) == ""


def test_normalized(spark):
    assert one(spark, [3.0, 4.0], V.normalized, "array<float>") == [0.6, 0.8] and one(spark, [0.0, 0.0], V.normalized, "array<float>") == [0, 0]
    assert one(spark, None, V.normalized, "array<float>") is None


def test_section_bias(spark):
    expected = {"Treatment": -0.5, "Case report": 0.75, "Conclusion": 0.2, "In summary": 0.75, "Exercise plan": -0.35, "Case report #3": 0.5, "Case study and treatment": -0.35, "Foo": 0, None: 0}
    for s, b in expected.items():
        assert one(spark, s, S.section_bias) == b


def test_section_priority(spark):
    for s, p in {"Resting position": 0, "Forest": 0, "Biomechanics of movement": 1, "Pain": 4, "Other": 7}.items():
        assert one(spark, s, S.section_priority) == p


def test_patient_stories_and_captions(spark):
    assert one(spark, "a 45 year old man", T.is_patient_story) and one(spark, "this patient had", T.is_patient_story)
    assert not one(spark, "patients often", T.is_patient_story)
    assert one(spark, "jaw clicking", T.is_caption) and not one(spark, "figured out", T.is_caption) and one(spark, "fig 2", T.is_caption)
    assert one(spark, "x" * 49, T.is_bad_chunk) and one(spark, "x" * 50 + " the source", T.is_bad_chunk) and not one(spark, "x" * 50 + " the sources", T.is_bad_chunk)


def test_rerank_replies(spark):
    f = lambda n: lambda c: T.rerank_scores(c, F.lit(n))
    assert one(spark, "8, 6.5, 0", f(3)) == [8, 6.5, 0]
    assert one(spark, "1: 8\n2: 6.5", f(2)) == [1, 8]
    assert one(spark, "12, -3", f(2)) == [10, 0]
    assert one(spark, "8, x", f(2)) is None
    assert one(spark, "", f(2)) == [0, 0]


def test_odd_numbers_placeholders_and_indexes(spark):
    assert one(spark, "2 , 7 , 19 , 21 text", T.looks_odd) and not one(spark, "Levels 4, 5 and 6", T.looks_odd)
    assert [one(spark, x, T.sanitized) for x in (" None ", "[]", " x ", None)] == ["[EMPTY]", "[EMPTY]", "x", "[EMPTY]"]
    assert [tuple(v) if (v := one(spark, x, T.chunk_index)) else None for x in ("3", "1.0", "1.1", "x")] == [(3, 0), (1, 0), (1, 1), None]


def test_citations_and_bibliography(spark):
    assert one(spark, "pain 2 , 7 , 19 here", T.without_citations) == "pain here"
    assert one(spark, "a (TOS) b (2004) c", T.without_citations) == "a b c"
    assert one(spark, "told 3x Smith Jones et al. 2001 and doi: 10.1/x here, DOI=y. Marks", T.without_citations) == "told 3x and here, Marks"
    assert one(spark, "il doit 1850 pas", T.without_citations) == "il doit 1850 pas" and one(spark, None, T.without_citations) == ""
    f = lambda c: T.without_bibliography(c, 50)
    w24, w25 = " ".join(["wordy"] * 24), " ".join(["wordy"] * 25)
    assert one(spark, w24, f) == "" and one(spark, w25, f) == w25 and one(spark, "a b c", f) == "a b c"


def test_long_prose_does_not_overflow_the_matcher(spark):
    text = "Aa Bb, " * 200_000 + "Smith John, 2019"
    assert one(spark, text, T.is_reference_block)


def test_causal_groups_and_windows(spark):
    s = ["A hurts.", "It hurts because B is tight.", "C follows.", "D is unrelated."]
    assert one(spark, s, C.causal_groups, "array<string>") == [" ".join(s[:3]), s[3]]
    for n, starts in {0: [], 4: [0], 5: [0, 4], 6: [0, 4], 9: [0, 4, 8]}.items():
        items = [str(i) for i in range(n)]
        assert one(spark, items, C.windows, "array<string>") == [" ".join(items[i : i + 6]) for i in starts]


def test_images(spark):
    def tiny(src):
        return one(spark, src, lambda c: H.is_tiny(H.image_dims(c)["width"], H.image_dims(c)["height"]))

    assert [tiny(x) for x in ("x-40x400.jpg", "x-60x49.png", "x-60x50.png", "x.png")] == [True, True, False, False]


def test_walk_of_blocks():
    page = "<html><body><nav><p>no</p></nav><h1>T</h1><p>a<br>b<p>c<script>'</p>'</script><ul><li>x</li></ul><figure><img data-src='u.png'></figure></body></html>"
    assert [(tag, text, [i["src"] for i in images]) for tag, text, _, _, images in H.walk(page)] == [("h1", "T", []), ("p", "a b", []), ("p", "c", []), ("ul", "x", []), ("figure", "", ["u.png"])]
    assert H.walk("") == []
