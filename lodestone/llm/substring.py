"""Exact substring deduplication on words by fixed-block anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import column, cut, pack_owned, planes, unpack_owned, unplanes
from .shared import bucket_bits, stored
from .words import mix, ngrams, row_firsts, text_slices, words

WINDOW = 13
#: Bytes of text that a part of the documents has about, and that a task packs at a time; bytes of text to a bucket of hashes.
PART_BYTES, PACK_BYTES, BUCKET_BYTES = 32 << 20, 32 << 20, 24 << 20
FLUSH_WINDOWS = 3 << 19
_LAST = (1 << 63) - 1


def _row_code(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One number for a row: from its id and the hash of its text."""
    return mix(ids.view(np.uint64) ^ mix(keys.view(np.uint64)))


def part_of(ids: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    return (_row_code(ids, keys) >> np.uint64(64 - bits)).astype(np.int64)


_FIELDS = ("doc_id", "id", "key", "text")


def _packed_rows(part_bits: int):
    """Documents by part, many in a row: their columns compressed together."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        part = part_of(table.column("id").to_numpy(), table.column("key").to_numpy(), part_bits)
        order = np.argsort(part, kind="stable")
        at = cut(part[order], 1 << part_bits)
        for b in np.flatnonzero(np.diff(at)):
            sink = pa.BufferOutputStream()
            mine = table.take(pa.array(order[at[b] : at[b + 1]]))
            with pa.ipc.new_stream(sink, mine.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(mine)
            yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                some = pa.RecordBatch.from_arrays([*(some.column(c) for c in _FIELDS[:3]), some.column("text").cast(pa.large_binary())], names=_FIELDS)
                held.append(some)
                size += some.column("text").nbytes
                if size >= PACK_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _unpacked(column: pa.ChunkedArray | pa.Array) -> Iterator[pa.Table]:
    for raw in column.to_pylist():
        yield pa.ipc.open_stream(raw).read_all().combine_chunks()


def _rolling(text: pa.Array, block: int):
    """Of each slice: first row, word hashes, their rows, index of each row's first word, hashes and first words of rolling blocks."""
    for row, end, buf, offsets in text_slices(text):
        h, rows = words(buf, offsets)
        grams, first = ngrams(h, rows, block)
        yield row, h, rows, row_firsts(rows, end - row), grams, first


_PROBES = "bucket int, part int, n int, frags binary, twice binary, anchor binary"


def _probe_rows(block: int, bits: int):
    """Rolling blocks of one part as sorted 32-bit fragments by bucket, with flags: seen twice, a reference block."""

    def flush(part: int, grams: list[np.ndarray], refs: list[np.ndarray]) -> pa.RecordBatch:
        g, a = np.concatenate(grams), np.concatenate(refs)
        order = np.argsort(g, kind="stable")
        g, a = g[order] >> (np.uint64(32) - np.uint64(bits)), a[order]
        new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        twice = np.diff(np.append(new, len(g))) > 1
        anchor = np.logical_or.reduceat(a, new)
        g = g[new]
        at = cut((g >> np.uint64(32)).astype(np.int64), 1 << bits)
        rows = []
        for b in np.flatnonzero(np.diff(at)):
            x = slice(at[b], at[b + 1])
            frag = (g[x] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows.append((int(b), part, len(frag), planes(np.diff(frag, prepend=np.uint32(0))), np.packbits(twice[x]).tobytes(), np.packbits(anchor[x]).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int32()] * 3, *[pa.binary()] * 3))], names=[x.split()[0] for x in _PROBES.split(", ")])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, refs, held, part = [], [], 0, key[0].as_py()
        for batch in batches:
            for docs in _unpacked(batch.column("docs")):
                for _, _, rows, firsts, g, first in _rolling(docs.column("text"), block):
                    if len(g):
                        grams.append(g)
                        refs.append((first - firsts[rows[first]]) % block == 0)
                        held += len(g)
                    if held >= FLUSH_WINDOWS:
                        yield flush(part, grams, refs)
                        grams, refs, held = [], [], 0
        if held:
            yield flush(part, grams, refs)

    return run


_HITS = "part int, bucket int, frags binary"


def _hit_rows(key: tuple, table: pa.Table) -> pa.Table:
    """Of one bucket, for every part: those of its blocks that are a reference block which some other window equals."""
    parts, marks, owners = [], [], []
    for part, n, raw, twice, anchor in zip(*(column(table, c) for c in ("part", "n", "frags", "twice", "anchor"))):
        frag = np.cumsum(unplanes(raw, np.uint32), dtype=np.uint32).astype(np.uint64) << np.uint64(2)
        flags = np.unpackbits(np.frombuffer(twice, np.uint8), count=n).astype(np.uint64) << np.uint64(1) | np.unpackbits(np.frombuffer(anchor, np.uint8), count=n)
        parts.append(frag | flags)
        owners.append(part)
    x = np.concatenate(parts)
    order = np.argsort(x)
    frag, flag = x[order] >> np.uint64(2), x[order] & np.uint64(3)
    new = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1]]))
    flags = np.bitwise_or.reduceat(flag, new)
    many = np.diff(np.append(new, len(x)))
    live = ((many > 1) | (flags >= 2)) & (flags & np.uint64(1)).astype(bool)
    mark = np.zeros(len(x), bool)
    mark[order] = np.repeat(live, many)
    at = 0
    for p in parts:
        marks.append((p[mark[at : at + len(p)]] >> np.uint64(2)).astype(np.uint32))
        at += len(p)
    rows = [(part, planes(np.diff(m, prepend=np.uint32(0)))) for part, m in zip(owners, marks) if len(m)]
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(rows), pa.int32()), "frags": pa.array([r[1] for r in rows], pa.binary())})


class _Hits:
    """The blocks of one part that are hits: a bit for each by its hash, and then exactly."""

    def __init__(self, buckets: list[int], frags: list[bytes], bits: int):
        found = [(np.cumsum(unplanes(f, np.uint32), dtype=np.uint32).astype(np.uint64) | np.uint64(b) << np.uint64(32)) for b, f in zip(buckets, frags)]
        self.all = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        self.shift = np.uint64(32 - bits)
        size = 1 << max(6, (8 * len(self.all)).bit_length())
        self.mask = np.uint64(size - 1)
        self.table = np.zeros(size, bool)
        self.table[self._at(self.all)] = True

    def _at(self, g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) & self.mask).astype(np.int64)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        g = g >> self.shift
        out = self.table[self._at(g)]
        some = np.flatnonzero(out)
        if len(some):
            at = np.searchsorted(self.all, g[some])
            at[at == len(self.all)] = 0
            out[some] = self.all[at] == g[some]
        return out


_WINDOWS = "bucket int, settled boolean, hashes binary, ids binary, keys binary, counts binary, places binary"


def _window_rows(block: int, window: int, bits: int, part_bits: int):
    """Hits extended to windows: by bucket of the window's hash, those whose first owner in this part is this row; the others are settled here."""

    def pack(out: list, bucket: np.ndarray, settled: bool, h, ids, keys, at) -> None:
        order = np.lexsort((at, keys, ids, bucket))
        bucket = bucket[order]
        new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
        for lo, hi in zip(new, np.append(new[1:], len(bucket)) if len(bucket) else []):
            x = order[lo:hi]
            out.append((int(bucket[lo]), settled, b"" if settled else h[x].tobytes(), *pack_owned(ids[x], keys[x], at[x])))

    def flush(out: list, held: list) -> None:
        h, ids, keys, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ids, h))
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        group = np.cumsum(new) - 1
        least = ids[order][new][group]
        later = np.empty(len(h), bool)
        later[order] = ids[order] > least
        s = np.flatnonzero(later)
        pack(out, part_of(ids[s], keys[s], part_bits), True, h[s], ids[s], keys[s], at[s])
        s = np.flatnonzero(~later)
        pack(out, (h[s] >> np.uint64(64 - bits)).astype(np.int64), False, h[s], ids[s], keys[s], at[s])

    def run(key: tuple, docs: pa.Table, hits: pa.Table) -> pa.Table:
        found = _Hits(column(hits, "bucket"), column(hits, "frags"), bits)
        out, held, n = [], [], 0
        for table in _unpacked(docs.column("docs")) if len(found.all) else ():
            ids_of, keys_of = (table.column(c).combine_chunks().to_numpy() for c in ("id", "key"))
            for row, h, rows, firsts, g, first in _rolling(table.column("text"), block):
                hit = np.zeros(len(h) + 1, np.int64)
                hit[first + 1] = found(g)
                np.cumsum(hit, out=hit)
                w, start = ngrams(h, rows, window)
                some = np.flatnonzero(hit[start + window - block + 1] > hit[start])
                if len(some):
                    w, start = w[some], start[some]
                    of = rows[start]
                    held.append((w, ids_of[row + of], keys_of[row + of], (start - firsts[of]).astype(np.uint32)))
                    n += len(some)
                if n >= FLUSH_WINDOWS:
                    flush(out, held)
                    held, n = [], 0
        if n:
            flush(out, held)
        cols = list(zip(*out)) or [[]] * 7
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), *[pa.binary()] * 5))], names=[x.split()[0] for x in _WINDOWS.split(", ")])

    return run


_REMOVED = "part int, ids binary, keys binary, counts binary, places binary"


def _owners(part_bits: int):
    """Of one bucket: the windows that a smaller id also has, by part of the row."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        h, ids, keys, at = [], [], [], []
        done = []
        for settled, hashes, *owned in zip(*(column(table, c) for c in ("settled", "hashes", "ids", "keys", "counts", "places"))):
            i, k, p = unpack_owned(*owned)
            if settled:
                done.append((i, k, p))
            else:
                h.append(np.frombuffer(hashes, np.uint64))
                ids.append(i)
                keys.append(k)
                at.append(p)
        if h:
            h, ids, keys, at = (np.concatenate(x) for x in (h, ids, keys, at))
            order = np.lexsort((ids, h))
            h, ids, keys, at = h[order], ids[order], keys[order], at[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            later = ids > ids[new][np.cumsum(new) - 1]
            done.append((ids[later], keys[later], at[later]))
        ids, keys, at = (np.concatenate(x) for x in zip(*done))
        part = part_of(ids, keys, part_bits)
        order = np.lexsort((at, keys, ids, part))
        part = part[order]
        new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        rows = []
        for lo, hi in zip(new, np.append(new[1:], len(part))):
            x = order[lo:hi]
            rows.append((int(part[lo]), *pack_owned(ids[x], keys[x], at[x])))
        cols = list(zip(*rows)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.binary()] * 4))], names=["part", "ids", "keys", "counts", "places"])

    return run


_KEPT = "doc_id bigint, n_words bigint, n_removed bigint, repeats array<struct<start: int, end: int>>, stretches array<struct<start: int, end: int>>, kept string"


def _runs(at: np.ndarray, window: int, gap: int) -> list[tuple[int, int]]:
    """(start, end) in words of windows that begin at most `gap` apart."""
    far = np.flatnonzero(np.diff(at) > gap)
    return list(zip(at[np.append(0, far + 1)].tolist(), (at[np.append(far, len(at) - 1)] + window).tolist()))


def _kept(window: int):
    """Rows of one part with what is removed from them."""

    def run(key: tuple, docs: pa.Table, gone: pa.Table) -> pa.Table:
        parts = [unpack_owned(*owned) for owned in zip(*(column(gone, c) for c in ("ids", "keys", "counts", "places")))]
        i, k, p = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        code = _row_code(i, k)
        order = np.argsort(code, kind="stable")
        code, p = code[order], p[order]
        out = []
        for table in _unpacked(docs.column("docs")):
            of_row = _row_code(*(table.column(c).combine_chunks().to_numpy() for c in ("id", "key")))
            lows, highs = np.searchsorted(code, of_row), np.searchsorted(code, of_row, "right")
            for doc_id, text, lo, hi in zip(table.column("doc_id").to_pylist(), table.column("text"), lows.tolist(), highs.tolist()):
                w, runs, stretches = (text.as_py() or b"").split(), [], []
                kept = w
                if hi > lo:
                    at = np.unique(p[lo:hi].astype(np.int64))
                    runs, stretches = ([{"start": s, "end": e} for s, e in _runs(at, window, gap)] for gap in (window, 1))
                    kept, begin = [], 0
                    for r in runs:
                        kept += w[begin : r["start"]]
                        begin = r["end"]
                    kept += w[begin:]
                out.append((doc_id, len(w), len(w) - len(kept), runs, stretches, b" ".join(kept).decode()))
        cols = list(zip(*out)) or [[]] * 6
        run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 3, run_type, run_type, pa.string()))], names=["doc_id", "n_words", "n_removed", "repeats", "stretches", "kept"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, repeats, stretches, kept): each text without the words that lie in a window of `window` words which a document with a smaller id also has.

    Reference blocks are the non-overlapping runs of `block` = (window + 1) // 2
    words of every text, so each window of any text holds a whole one at some
    offset. Every rolling window of that length probes them; a hit is a
    reference block that equals another window. Hits go back to the part of the
    documents that they come from, and are extended there to all windows around
    them; these are compared by the hash of all their words. The union of a text's
    equal windows are its `repeats`, in words; `stretches` are the maximal ones in which
    every window recurs earlier: two that overlap or touch stay two there, as no
    window over their border recurs.

    Documents travel packed and compressed, dealt by a hash of id and text, in
    parts whose number grows with the bytes; probes as sorted hash fragments, one
    row for each part and bucket, hits likewise. Nothing is broadcast and nothing
    of the data comes to the driver but one sum. Of a window that recurs within a
    part only the first owner travels on, so a passage in a third of all texts
    brings one row for each part, not one for each text.

    Null text: no words. Null id: after all others, and never owner of a window
    against another null. Rows that repeat an id don't remove each other's
    words. Other columns are ignored. Empty table: empty result.
    """
    spark, block = docs.sparkSession, (window + 1) // 2
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("id"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("key"), F.col(text_col).cast("string").alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_bits = min(20, max(bucket_bits(spark, 1), (total // PART_BYTES).bit_length()))
    bits = min(24, max(bucket_bits(spark, 2), (total // BUCKET_BYTES).bit_length()))
    packed = base.mapInArrow(_packed_rows(part_bits), "part int, docs binary")
    probes = packed.groupBy("part").applyInArrow(_probe_rows(block, bits), _PROBES)
    hits = stored(probes.groupBy("bucket").applyInArrow(_hit_rows, _HITS), "hits")
    windows = packed.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(_window_rows(block, window, bits, part_bits), _WINDOWS)
    removed = stored(windows.groupBy("bucket").applyInArrow(_owners(part_bits), _REMOVED), "removed")
    return packed.groupBy("part").cogroup(removed.groupBy("part")).applyInArrow(_kept(window), _KEPT)


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of substring_dedup over all documents."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM w, unnest(generate_series(1, len(ws) - 12)) AS t(i)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first_id FROM g),
r AS (SELECT doc_id, list(DISTINCT j) AS gone FROM m, unnest(generate_series(i, i + 12)) AS t(j) WHERE first_id < doc_id GROUP BY doc_id),
k AS (SELECT doc_id, len(ws) AS n, coalesce(len(gone), 0) AS n_gone, CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, p: NOT list_contains(gone, p)) END AS kept FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_gone AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
