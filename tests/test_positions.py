"""Joins by place over several files and row groups against Python's zip."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestone.operators import positions
from lodestone.sources import npy


@pytest.fixture()
def files(tmp_path):
    """(texts in order, a folder of Parquet files with many row groups, vectors in order, a folder of NPY files)."""
    r = np.random.default_rng(1)
    texts = [f"text {i}" for i in r.permutation(2500)]
    (tmp_path / "t").mkdir()
    (tmp_path / "v").mkdir()
    for name, a, b in (("part-0", 0, 700), ("part-1", 700, 700), ("part-10", 700, 1900), ("part-2", 1900, 2500)):
        pq.write_table(pa.table({"text": texts[a:b], "n": pa.array(range(a, b), pa.int32())}), str(tmp_path / "t" / f"{name}.parquet"), row_group_size=111)
    x = r.standard_normal((2500, 3)).astype(np.float32)
    for name, a, b in (("a", 0, 1), ("b", 1, 1600), ("c", 1600, 2500)):
        np.save(tmp_path / "v" / f"{name}.npy", x[a:b])
    return texts, str(tmp_path / "t"), x, str(tmp_path / "v")


def test_rows_meet_by_place(spark, files):
    texts, table, x, folder = files
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several tasks a file
    left = positions.parquet_rows(spark, table)
    right = positions.numbered(npy.read(spark, folder, 600), "file", "row").drop("file", "row")
    got = sorted(positions.joined(left, right).collect(), key=lambda r: r["position"])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["position"] for r in got] == list(range(2500)) == [r["n"] for r in got] and [r["text"] for r in got] == texts
    assert np.array_equal(np.array([r["vec"] for r in got], np.float32), x)


def test_unequal_numbers(spark, files):
    _, table, _, _ = files
    left = positions.parquet_rows(spark, table)
    right = left.where("position < 2000 or position >= 2400").withColumn("position", left["position"]).where("position < 2000")
    with pytest.raises(ValueError, match="2500 rows on the left and 2000 on the right"):
        positions.joined(left, right)
    assert positions.joined(left, right, policy="truncate").count() == 2000
    both = positions.joined(left, right, policy="outer")
    assert both.columns == ["position", "text", "n", "right_text", "right_n"] and both.where("right_n is null").count() == 500
    with pytest.raises(ValueError, match="no policy"):
        positions.joined(left, right, policy="warn")


def test_mismatches(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b"), (2, None), (3, "d"), (4, "e")], "position long, k string")
    b = spark.createDataFrame([(0, "a"), (1, "x"), (2, None), (3, "d")], "position long, k string")
    assert tuple(positions.mismatches(a, b, "k", "k").first()) == (5, 2, 1, 0, 1)
    assert tuple(positions.mismatches(b, a, "k", "k").first()) == (5, 2, 0, 1, 1)
    assert tuple(positions.mismatches(a.limit(0), b.limit(0), "k", "k").first()) == (0, 0, 0, 0, None)
