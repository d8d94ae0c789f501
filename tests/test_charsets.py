"""Guessed charsets and texts read anew, on samples of many languages and on whole tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import charsets as C
from lodestone.plans import catalog
from lodestone.sources import tables

SAMPLES = {
    "French": ("Où est la forêt ? Le garçon a mangé une pêche très mûre, près de l'église – c'était l'été, naïf et çà et là « doré ».", ("cp1252",)),
    "German": ("Die Bäume wachsen größer, über den Dächern hört man Vögel; Ärger gibt es überall in Österreich. „Schön“, sagte er.", ("cp1252",)),
    "Spanish": ("¿Dónde está el niño? Mañana iré a la montaña con mi compañero; ¡qué corazón más grande! Él llegó ayer.", ("cp1252",)),
    "Polish": ("Zażółć gęślą jaźń. Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są też obdarzeni rozumem.", ("cp1250", "iso8859_2")),
    "Czech": ("Příliš žluťoučký kůň úpěl ďábelské ódy. Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv; řeka teče.", ("cp1250", "iso8859_2")),
    "Hungarian": ("Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az erdőben fűzfák nőnek, őszi idő van.", ("cp1250", "iso8859_2")),
    "Russian": ("Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью, Москва.", ("cp1251", "koi8_r", "iso8859_5")),
}


@pytest.mark.parametrize("language", SAMPLES)
def test_bytes_are_read_as_they_were_written(language):
    text, names = SAMPLES[language]
    page = f"<html><body><p>{text}</p><p>plain words around it, as pages have them</p></body></html>"
    for name in (*names, "utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-32"):
        assert C.text_of_bytes(page.encode(name)) == page, (name, C.charset_of(page.encode(name)))


@pytest.mark.parametrize("line", ["Üü schteä ungü eniegeß", "ñó miñmi ííos", "Éçé èvi", "óí ción", "éêeuxch ére"])
def test_western_words_stay_western_however_often_a_line_recurs(line):
    page = "<html><body>" + f"<p>{line}</p>" * 60 + "<p>Gar ieß, asíque</p></body></html>"
    assert C.text_of_bytes(page.encode("latin-1")) == page, C.charset_of(page.encode("latin-1"))


def test_pages_that_begin_with_a_mark_or_end_in_a_line_separator(spark, tmp_path):
    texts = ["\ufeff<p>x</p>", "<p>x</p>\u2028", "<p>x</p>\u0085", "<p>x</p>\n", "<p>asíque ción</p>", "", None]
    rows = [(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.digest for r in catalog.queries()["page_charsets"](spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in rows}


@pytest.mark.parametrize("raw", [b"", b"a", b"\xff", b"\x00", b"\x80\x81\x8d", b"\xff\xfe", bytes(range(256)), b"\xfe\xff\xd8"])
def test_any_bytes_have_a_text(raw):
    assert isinstance(C.text_of_bytes(raw), str)


def test_wrongly_read_texts_come_back():
    for language, (text, _) in SAMPLES.items():
        for name, least in C.TAKEN_FOR:
            if (least > 1 and language != "Russian") or (name == "mac_roman" and language not in ("French", "German", "Spanish")):
                continue  # single letters are not believed in Cyrillic, nor sequences of letters alone in Mac Roman
            wrong = text
            for _ in range(2):
                shown = {b: c for c, b in C._table(name).items()}
                wrong = "".join(chr(b) if b < 0x80 else shown[b] for b in wrong.encode())
                assert C.redecoded(wrong) == text, (name, wrong)
    half = "Sound: Bär, forêt. " + "Wrong: größer – “so”".encode().decode("latin-1")
    assert C.redecoded(half) == "Sound: Bär, forêt. Wrong: größer – “so”"
    assert C.redecoded("donâ€™t stopâ€¦ 5 â‚¬") == "don’t stop… 5 €"


@pytest.mark.parametrize("text", [*(t for t, _ in SAMPLES.values()), "É… Ä“ MANHÃ” Ü‡", "Рёбра и Рє", "√9 ≈ 3, ¬p, 5 ‚x‘", "x² Ã la carte", "", "plain", "Ærø, Łódź, naïve façade", "漢字とかな", "\U0001f600 ok"])
def test_sound_texts_stay(text):
    assert C.redecoded(text) == text


def test_pages_of_many_charsets(spark, tmp_path):
    for language, (text, names) in SAMPLES.items():
        for name in (*names, "utf-8-sig", "utf-16"):
            folder = tmp_path / language / name
            folder.mkdir(parents=True)
            (folder / "index.html").write_bytes(f"<html><p>{text} {text}</p></html>".encode(name))
    got = [r.html for r in tables.html_files(spark, str(tmp_path), guess=True).collect()]
    assert sorted(got) == sorted(f"<html><p>{text} {text}</p></html>" for text, names in SAMPLES.values() for _ in range(len(names) + 2))


def test_whole_tables_in_a_western_charset(spark):
    rows = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    western = [t for t in rows if t.encode("cp1252", "ignore").decode("cp1252") == t]
    assert len(western) > 0.9 * len(rows)
    wrong = [t[:40] for t in western if C.text_of_bytes(t.encode("cp1252")) != t]
    assert len(wrong) <= 0.002 * len(western), wrong
    df = spark.createDataFrame([(i, t.encode("cp1252")) for i, t in enumerate(western)], "i int, raw binary").select("i", C.decoded(F.col("raw")).alias("t"))
    assert sum(western[r.i] == r.t for r in df.collect()) == len(western) - len(wrong)
