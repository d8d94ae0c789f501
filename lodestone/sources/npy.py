"""NPY matrices as a Spark source: the header tells where rows lie, and each range of rows is read by a task of its own."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range of rows, about; what a header is read from at most; rows of an Arrow batch.
RANGE, HEADER, BATCH = 32 << 20, 1 << 16, 4096
_MAGIC = b"\x93NUMPY"


def header_of(head: bytes) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """(type, columns first, shape, where the data begin) of an NPY file by its first bytes; ValueError where it is none or holds no numbers."""
    if head[:6] != _MAGIC:
        raise ValueError("not an NPY file")
    wide = head[6] > 1
    size, begin = (struct.unpack("<I", head[8:12])[0], 12) if wide else (struct.unpack("<H", head[8:10])[0], 10)
    if begin + size > len(head):
        raise ValueError("the header is cut off")
    told = ast.literal_eval(head[begin : begin + size].decode("utf-8" if head[6] > 2 else "latin-1"))
    kind = np.dtype(told["descr"])
    if kind.kind not in "fiub":
        raise ValueError(f"an NPY file of {kind}")
    return kind, bool(told["fortran_order"]), tuple(told["shape"]), begin + size


def _store(path: str):
    """(file system, path there) of a path or an address that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The NPY files at a path: itself, or those in the folder, by name."""
    from pyarrow import fs

    store, place = _store(path)
    root = path[: len(path) - len(place)] if path.endswith(place) else "file://"
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [i for i in store.get_file_info(fs.FileSelector(place)) if i.is_file and i.path.endswith(".npy")]
    return sorted(root + i.path for i in found)


class Rows(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        """Ranges of rows, from the headers alone."""
        out: list[InputPartition] = []
        for path in _files(self.path):
            store, place = _store(path)
            with store.open_input_file(place) as f:
                kind, _, shape, _ = header_of(f.read_at(min(HEADER, f.size()), 0))
            n, width = shape[0] if shape else 1, int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
            step = max(1, self.size // max(1, width))
            out += [Rows(path, at, min(n, at + step)) for at in range(0, n, step)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, place = _store(partition.path)
        with store.open_input_file(place) as f:
            kind, columns_first, shape, begin = header_of(f.read_at(min(HEADER, f.size()), 0))
            n, inner = shape[0] if shape else 1, shape[1:]
            dim = int(np.prod(inner, dtype=np.int64))
            if begin + n * dim * kind.itemsize > f.size():
                raise ValueError(f"{partition.path} is cut off")
            for at in range(partition.first, partition.end, BATCH):
                m = min(partition.end, at + BATCH) - at
                if columns_first and inner:  # each component's values of these rows lie together
                    parts = [np.frombuffer(f.read_at(m * kind.itemsize, begin + (c * n + at) * kind.itemsize), kind) for c in range(dim)]
                    x = np.stack(parts, axis=1).reshape(m, *inner[::-1]).transpose(0, *range(len(inner), 0, -1)) if dim else np.zeros((m, 0))
                else:
                    x = np.frombuffer(f.read_at(m * dim * kind.itemsize, begin + at * dim * kind.itemsize), kind)
                flat = np.ascontiguousarray(x).reshape(-1).astype(np.float32)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * dim), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path.rpartition("/")[2]] * m), pa.array(np.arange(at, at + m)), vec], names=["file", "row", "vec"])


class NpySource(DataSource):
    """format("npy"): (file, row, vec) of the rows of NPY matrices; option range: bytes of a task's rows."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, row bigint, vec array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))


def read(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, row, vec) of an NPY file, or of all in a folder, at a path or address that Arrow opens on every machine.

    Any real or whole numbers, in either byte order and either order of axes,
    become floats; further axes of a row are laid out one behind the other, and a
    one-dimensional file has rows of one component. A file that is cut off, of
    other values or none at all fails.
    """
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("range", size).load(path)
