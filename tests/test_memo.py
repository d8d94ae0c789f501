"""Models are asked once for each different text, over runs that fail and start again."""

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import memo


def asking(folder, lose=None, fail=()):
    """A model that leaves a file for every text that it is asked; it is lost at one text while the file `lose` is there, and can't take some."""

    def model():
        def reply(texts):
            for t in texts:
                if t in fail:
                    raise ValueError(t)
                if lose and os.path.exists(lose) and t == "t7":
                    raise OSError("lost")
                with open(f"{folder}/{uuid.uuid4()}", "w") as f:
                    f.write(t)
            return [f" re: {t} " for t in texts]

        return reply

    return model


def asked(folder):
    return sorted(open(f"{folder}/{n}").read() for n in os.listdir(folder))


@pytest.fixture()
def rows(spark):
    texts = [f"t{i}" for i in range(20)] + ["t3"] * 40 + [None, ""]
    return spark.createDataFrame([(i, t, "v") for i, t in enumerate(texts)], "id int, text string, value string").repartition(5)


def test_every_text_is_asked_once(spark, tmp_path, rows):
    folder = tmp_path / "asked"
    folder.mkdir()
    some = lambda r: memo.replies(r, F.col("text"), memo.Memo(spark, str(tmp_path / "m"), "one"), asking(folder))
    assert some(rows.where("id < 5")).count() == 5
    got = {r["id"]: (r["text"], r["reply"], r["value"]) for r in some(rows).collect()}
    assert len(got) == 62 and all(reply == f"re: {t or ''}".strip() and v == "v" for t, reply, v in got.values())
    assert asked(folder) == sorted({f"t{i}" for i in range(20)} | {""})
    some(rows).count()
    assert len(asked(folder)) == 21
    with pytest.raises(ValueError, match="of one, not of two"):
        memo.Memo(spark, str(tmp_path / "m"), "two")


def test_a_lost_job_goes_on(spark, tmp_path, rows):
    folder, lose = tmp_path / "asked", tmp_path / "lose"
    folder.mkdir()
    lose.touch()
    table = memo.Memo(spark, str(tmp_path / "m"), "one", slices=16)
    with pytest.raises(Exception, match="lost"):
        memo.replies(rows, F.col("text"), table, asking(folder, str(lose)))
    kept = {r["value"] for r in table.kept().collect()}
    first = asked(folder)
    lose.unlink()
    got = memo.replies(rows, F.col("text"), table, asking(folder, str(lose)))
    assert got.where("reply is null").count() == 0 and 0 < len(kept) < 21
    again = [t for t in set(first) if asked(folder).count(t) > first.count(t)]
    assert not {f"re: {t}".strip() for t in again} & kept  # only the lost slice is asked again


def test_fallbacks_are_asked_again(spark, tmp_path, rows):
    folder = tmp_path / "asked"
    folder.mkdir()
    table = memo.Memo(spark, str(tmp_path / "m"), "one", pause=0.001, batch=4)
    got = {r["text"]: r["reply"] for r in memo.replies(rows, F.col("text"), table, asking(folder, fail=("t3", "t5")), fallback="sorry").collect()}
    assert got["t3"] == got["t5"] == "sorry" and got["t4"] == "re: t4"
    got = {r["text"]: r["reply"] for r in memo.replies(rows, F.col("text"), table, asking(folder), fallback="sorry").collect()}
    assert got["t3"] == "re: t3" and "sorry" not in got.values()


def test_vectors_follow_their_texts(spark, tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()

    model = asking(folder)

    def encoder():
        reply = model()
        return lambda texts: np.array([[len(t), 3.0, i * 0] for i, t in enumerate(texts) if reply([t])])

    table = memo.Memo(spark, str(tmp_path / "m"), "lengths", "array<float>")
    docs = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    first = {r["id"]: r["embedding"] for r in memo.vectors(docs("four", " ", "more"), "text", table, encoder).collect()}
    assert first[0] == pytest.approx([0.8, 0.6, 0.0]) and first[0] == first[2]
    n = len(asked(folder))
    again = {r["id"]: r["embedding"] for r in memo.vectors(docs("four", None, "more"), "text", table, encoder).collect()}
    assert again == first and len(asked(folder)) == n
    memo.vectors(docs("four", "changed", "more"), "text", table, encoder).count()
    assert len(asked(folder)) == n + 1
