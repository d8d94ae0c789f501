"""NPY files read in ranges of rows against numpy."""

import numpy as np
import pytest

from lodestone.sources import npy


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", ["<f4", ">f8", "<f2", "<i8", "|u1", "|b1"])
def test_ranges_of_rows(spark, tmp_path, order, kind):
    r = np.random.default_rng(1)
    x = np.asarray(r.integers(0, 2, (1003, 7)) if kind == "|b1" else r.integers(0, 200, (1003, 7)), np.dtype(kind), order=order)
    np.save(tmp_path / "x.npy", x)
    df = npy.read(spark, str(tmp_path / "x.npy"), 2000)
    got = sorted(df.collect(), key=lambda g: g["row"])
    assert [g["row"] for g in got] == list(range(1003)) and {g["file"] for g in got} == {"x.npy"}
    assert np.array_equal(np.array([g["vec"] for g in got], np.float32), x.astype(np.float32))
    assert df.rdd.getNumPartitions() == -(-1003 // max(1, 2000 // (7 * x.itemsize)))


def test_folders_shapes_and_versions(spark, tmp_path):
    a, b, c = np.arange(24, dtype=np.float32).reshape(4, 2, 3), np.arange(5.0), np.asfortranarray(np.arange(24, dtype=np.float32).reshape(4, 2, 3))
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", b)
    np.save(tmp_path / "c.npy", c)
    np.save(tmp_path / "d.npy", np.zeros((0, 3), np.float32))
    np.lib.format.write_array(open(tmp_path / "e.npy", "wb"), b, version=(2, 0))
    (tmp_path / "note.txt").write_text("x")
    got = {}
    for r in npy.read(spark, f"file://{tmp_path}", 16).collect():
        got.setdefault(r["file"], {})[r["row"]] = r["vec"]
    flat = {i: v.ravel().tolist() for i, v in enumerate(a)}
    ones = {i: [float(i)] for i in range(5)}
    assert got == {"a.npy": flat, "b.npy": ones, "c.npy": flat, "e.npy": ones}


def test_what_is_no_matrix_fails(spark, tmp_path):
    np.save(tmp_path / "o.npy", np.array([["a", "b"]]))
    (tmp_path / "t.npy").write_bytes(b"no matrix")
    np.save(tmp_path / "s.npy", np.ones((50, 4)))
    whole = (tmp_path / "s.npy").read_bytes()
    (tmp_path / "s.npy").write_bytes(whole[:-8])
    for name in ("o", "t", "s", "missing"):
        with pytest.raises(Exception):
            npy.read(spark, str(tmp_path / f"{name}.npy")).collect()
