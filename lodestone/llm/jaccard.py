"""Jaccard join on word shingles with adaptive multi-match prefixes, and the groups it links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Forest, components
from .packed import column, cut, planes, unplanes, xxhash64
from .shared import bucket_bits, stored, with_values
from .words import mix, ngrams, row_firsts, text_slices, words

SHINGLE, SIMILARITY = 5, 80
SKETCH_BITS, SKETCH_SLICES = 20, 16
MATCHES = 4
#: log2 of the bits that say which sets are wanted: 16 for each set, between these.
FILTER_BITS = (16, 27)
FLUSH_TOKENS, FLUSH_PAIRS = 1 << 20, 2 << 20
#: Work for a candidate that is verified, as against one posting that is counted.
VERIFY_COST = 40
#: A token list of more components than DENSE is first joined through PIVOTS of its sets, in so many rounds at most.
DENSE, PIVOTS, ROUNDS = 256, 4, 3
#: A longer token list is cut into blocks of about so many sets, and every two of its blocks meet in a task of their own.
BLOCK = 8192
#: Postings that a bucket of tokens has about.
BUCKET = 1 << 20


def _sets(batch: pa.RecordBatch, k: int, wanted: np.ndarray | None = None):
    """(row, hashes) of every text with a word: its distinct k-word shingles; a shorter text is one shingle."""
    text = batch.column("text")
    if wanted is not None:
        text = pa.array(np.where(wanted, text.to_numpy(zero_copy_only=False), ""), pa.string())
    for row, end, buf, offsets in text_slices(text):
        h, rows = words(buf, offsets, lower=True)
        at = row_firsts(rows, end - row)
        g, first = ngrams(h, rows, k)
        bound = np.searchsorted(first, at)
        for i in range(end - row):
            lo, hi = bound[i], bound[i + 1]
            if hi > lo:
                yield row + i, np.unique(g[lo:hi])
            elif n := at[i + 1] - at[i]:
                yield row + i, ngrams(h[at[i] : at[i + 1]], rows[at[i] : at[i + 1]], n)[0]


def _sketch_rows(k: int):
    """How often each of 2**SKETCH_BITS hash classes of shingles occurs in this task, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, some = np.zeros(1 << SKETCH_BITS, np.uint32), False
        for batch in batches:
            for _, _, buf, offsets in text_slices(batch.column("text")):
                g, _ = ngrams(*words(buf, offsets, lower=True), k)
                if len(g):
                    np.add.at(count, (g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
                    some = True
        if some:
            yield from _sliced(count)

    return run


def _sliced(count: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = len(count) // SKETCH_SLICES
    yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array([planes(count[i * step : i * step + step]) for i in range(SKETCH_SLICES)], pa.binary())], names=["slice", "counts"])


def _list_class(token: np.ndarray) -> np.ndarray:
    return (mix(token) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _list_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of this task have each of 2**SKETCH_BITS classes of prefix tokens, in slices."""
    count, some = np.zeros(1 << SKETCH_BITS, np.uint32), False
    for batch in batches:
        held = [np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()]
        if held:
            np.add.at(count, _list_class(np.concatenate(held)), np.uint32(1))
            some = True
    if some:
        yield from _sliced(count)


def _sketch_sum(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_SLICES, np.uint64)
    for batch in batches:
        for raw in batch.column("counts").to_pylist():
            total += unplanes(raw, np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())], names=["slice", "counts"])


def least_overlap(n, percent: int):
    """The fewest shingles that a set of n shares with any set at or above the similarity."""
    return -(-n * percent // 100)


def _prefix_rows(k: int, percent: int, sketch):
    """Of every text: size and fingerprint of its set, matches required of it and the tokens of its longest prefix, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            freq = np.frombuffer(sketch.value, np.uint32)
            n = len(batch)
            size, node, need = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32)
            tokens: list[bytes | None] = [None] * n
            for row, x in _sets(batch, k):
                m = len(x)
                size[row] = m
                node[row] = mix(np.array([np.bitwise_xor.reduce(mix(x)) + np.uint64(m)], np.uint64)).view(np.int64)[0]
                f = np.minimum(freq[(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64)
                token = f << np.uint64(40) | x & np.uint64((1 << 40) - 1)
                least = least_overlap(m, percent)
                first = m - least + 1
                longest = min(m, first + min(MATCHES, least) - 1)
                token = np.partition(token, longest - 1)[:longest]
                token.sort()
                cost = np.cumsum((token >> np.uint64(40)).astype(np.float64))[first - 1 :]
                need[row] = 1 + int(np.argmin(cost * (1 + VERIFY_COST / np.arange(1, len(cost) + 1))))
                tokens[row] = token.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size), pa.array(node), pa.array(need), pa.array(tokens, pa.binary())], names=["id", "n", "node", "need", "tokens"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in run(iter([batch])):
                yield out.append_column("hash", batch.column("hash")).append_column("row", batch.column("row"))

    return keyed


_POSTINGS = "bucket int, cell bigint, tokens binary, nodes binary, sizes binary, levels binary, needs binary, comps binary"


def _side(node: np.ndarray, many: np.ndarray, turn: int) -> np.ndarray:
    """The block of a set in a list of `many` blocks; each turn deals them anew."""
    return (mix(node.view(np.uint64) + np.uint64(turn)) % many.astype(np.uint64)).astype(np.int64)


def _posting_rows(percent: int, bits: int, blocks, dense=None, turn: int = 0):
    """Prefix tokens by bucket of their hash and cell of their list; blocks: how many each class of tokens has.

    A list of one block is cell 0; of a longer one, every two blocks are a cell.
    With `dense`, a flag for each class of tokens, only flagged ones, and each block
    alone. comps is what tells the component from the set, nothing for most.
    """

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        token, node, size, level, need, comp = (np.concatenate(x) for x in zip(*held))
        bucket = (mix(token) >> np.uint64(64 - bits)).astype(np.int64)
        many = np.frombuffer(blocks.value, np.int32)[_list_class(token)].astype(np.int64)
        at, cell = np.arange(len(token)), np.zeros(len(token), np.int64)
        split = np.flatnonzero(many > 1)
        if len(split):
            mine = _side(node[split], many[split], turn)
            if dense is not None:
                cell[split] = 1 + mine
            else:
                each = many[split]
                copy = np.repeat(split, each)
                other = np.arange(len(copy)) - np.repeat(np.cumsum(each) - each, each)
                own = np.repeat(mine, each)
                at = np.concatenate([np.flatnonzero(many == 1), copy])
                cell = np.concatenate([np.zeros(len(at) - len(copy), np.int64), 1 + np.minimum(own, other) * many[copy] + np.maximum(own, other)])
        key = bucket[at]
        order = np.lexsort((cell, key))
        at, cell, key = at[order], cell[order], key[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
        rows = []
        for lo, hi in zip(new, np.append(new[1:], len(at))):
            x = at[lo:hi]
            rows.append((int(key[lo]), int(cell[lo]), token[x].tobytes(), node[x].tobytes(), planes(size[x]), level[x].tobytes(), need[x].tobytes(), planes(comp[x] ^ node[x])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 6))], names=["bucket", "cell", "tokens", "nodes", "sizes", "levels", "needs", "comps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        flags = None if dense is None else np.frombuffer(dense.value, bool)
        for batch in batches:
            for n, node, need, raw, comp in zip(*(batch.column(c).to_pylist() for c in ("n", "node", "need", "tokens", "comp"))):
                token = np.frombuffer(raw, np.uint64)
                m = len(token)
                level = np.maximum(1, np.arange(m) - (n - least_overlap(n, percent)) + 1).astype(np.uint8)
                if flags is not None:
                    some = flags[_list_class(token)]
                    token, level, m = token[some], level[some], int(some.sum())
                    if not m:
                        continue
                held.append((token, np.full(m, node), np.full(m, n, np.uint32), level, np.full(m, need, np.uint8), np.full(m, comp)))
                total += m
                if total >= FLUSH_TOKENS:
                    yield from flush(held)
                    held, total = [], 0
        if held:
            yield from flush(held)

    return run


_PAIRS = "part int, a binary, b binary, matches binary, needs binary"


def _candidate_rows(percent: int, bits: int, blocks, dense: int = 0):
    """Of one cell: pairs of sets of different components whose prefixes hold the same token and whose sizes allow the similarity, with the count.

    With `dense`: of token lists of more components than that, the pairs of PIVOTS sets with all others.
    """

    def pack(a, b, count, need) -> Iterator[pa.RecordBatch]:
        side = lambda x: (xxhash64(x) >> np.uint64(64 - bits)).astype(np.int64)
        part = side(a) << bits | side(b)
        order = np.lexsort((b, a, part))
        at = cut(part[order], 1 << 2 * bits)
        rows = []
        for p in np.flatnonzero(np.diff(at)):
            x = order[at[p] : at[p + 1]]
            rows.append((int(p), a[x].tobytes(), b[x].tobytes(), count[x].tobytes(), need[x].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=["part", "a", "b", "matches", "needs"])

    def merged(held: list) -> Iterator[pa.RecordBatch]:
        a, b, need = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        count = np.minimum(np.diff(np.append(new, len(a))), 255).astype(np.uint8)
        yield from pack(a[new], b[new], count, need[new])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[], [], [], [], [], []]
        cell = key[1].as_py()
        for t in batches:
            for c, name, kind in zip(cols, ("tokens", "nodes", "sizes", "levels", "needs"), (np.uint64, np.int64, None, np.uint8, np.uint8)):
                c += [unplanes(x, np.uint32) if kind is None else np.frombuffer(x, kind) for x in t.column(name).to_pylist()]
            cols[5] += [unplanes(x, np.int64) ^ np.frombuffer(y, np.int64) for x, y in zip(t.column("comps").to_pylist(), t.column("nodes").to_pylist())]
        token, node, size, level, need, comp = (np.concatenate(c) for c in cols)
        order = np.lexsort((node, comp, token))
        token, node, size, level, need, comp = (x[order] for x in (token, node, size, level, need, comp))
        size = size.astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(start, len(token)))
        last = np.repeat(start + length, length)
        # a component's sets stand together in a list: end is where the next component begins
        first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (comp[1:] != comp[:-1])]))
        width = np.diff(np.append(first, len(token)))
        end = np.repeat(first + width, width)
        if dense:
            at = np.searchsorted(first, start)
            runs = np.diff(np.append(at, len(first)))
            for k in range(PIVOTS):
                for x in first[at[runs > dense] + k]:
                    y = np.arange(end[x], last[x])
                    y = y[100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])]
                    if len(y):
                        yield from merged([(np.full(len(y), node[x]), node[y], np.ones(len(y), np.uint8))])
            return
        side = None
        if cell:  # two blocks meet: sets of one of them meet in a cell of their own
            many = np.frombuffer(blocks.value, np.int32)[_list_class(token)].astype(np.int64)
            side = np.where((cell - 1) // many == (cell - 1) % many, -1 - np.arange(len(token)), _side(node, many, 0))
        # every posting meets those of later components in its list: the 1st, 2nd, ... of them over all lists at once
        held, total = [], 0
        at = np.arange(len(token))
        step = 0
        at = at[end[at] < last[at]]
        while len(at):
            x, y = at, end[at] + step
            ell = np.maximum(need[x], need[y])
            ok = (level[x] <= ell) & (level[y] <= ell) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
            if side is not None:
                ok &= side[x] != side[y]
            x, y = x[ok], y[ok]
            held.append((node[x], node[y], ell[ok]))
            total += len(x)
            if total >= FLUSH_PAIRS:
                yield from merged(held)
                held, total = [], 0
            step += 1
            at = at[end[at] + step < last[at]]
        if total:
            yield from merged(held)

    return run


def _required_pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of one part that share as many prefix tokens as they need; the others can't be similar."""
    a, b, count, need = [], [], [], []

    def fold() -> None:
        x, y, c, n = (np.concatenate(v) for v in (a, b, count, need))
        order = np.lexsort((y, x))
        x, y, c, n = x[order], y[order], c[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        a[:], b[:], need[:] = [x[new]], [y[new]], [n[new]]
        count[:] = [np.minimum(np.add.reduceat(c, new), 255)]

    for t in batches:
        a += [np.frombuffer(x, np.int64) for x in t.column("a").to_pylist()]
        b += [np.frombuffer(x, np.int64) for x in t.column("b").to_pylist()]
        count += [np.frombuffer(x, np.uint8).astype(np.int64) for x in t.column("matches").to_pylist()]
        need += [np.frombuffer(x, np.uint8) for x in t.column("needs").to_pylist()]
        if sum(map(len, a)) > 4 * FLUSH_PAIRS:
            fold()
    fold()
    ok = np.flatnonzero(count[0] >= need[0])
    part = key[0].as_py()
    for i in range(0, len(ok), 1 << 18):
        x = ok[i : i + (1 << 18)]
        p, q = a[0][x], b[0][x]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([p.tolist()], pa.list_(pa.int64())), pa.array([q.tolist()], pa.list_(pa.int64()))], names=["part", "a", "b"])


def _verified(percent: int):
    """Links among the candidate pairs of one part, without those that a chain of others implies."""

    def run(key: tuple, pairs: pa.Table, sets: pa.Table) -> pa.Table:
        found = {n: np.frombuffer(s, np.uint64) for n, s in zip(sets.column("node").to_pylist(), sets.column("shingles").to_pylist())}
        names = sorted(found)
        number = {n: i for i, n in enumerate(names)}
        forest = Forest(len(names))
        for xs, ys in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            held, mark = None, None
            for x, y in zip(xs, ys):
                i, j = number[x], number[y]
                if forest.find(i) == forest.find(j):
                    continue
                if held != x:
                    held, mark = x, found[x]
                other = found[y]
                at = np.searchsorted(mark, other)
                at[at == len(mark)] = 0
                shared = int(np.count_nonzero(mark[at] == other))
                if 100 * shared >= percent * (len(mark) + len(other) - shared):
                    forest.union(i, j)
        a = [names[i] for i, _ in forest.kept]
        b = [names[j] for _, j in forest.kept]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _wanted_sets(k: int, bits_words, filter_bits: int):
    """Sets of the texts whose id may be one of the wanted: a filter of bits, whose false positives a join removes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = _held(bits_words, filter_bits, xxhash64(batch.column("id").to_numpy(zero_copy_only=False)))
            if not wanted.any():
                continue
            node, sets, seen = [], [], set()
            for row, x in _sets(batch, k, wanted):
                key = int(mix(np.array([np.bitwise_xor.reduce(mix(x)) + np.uint64(len(x))], np.uint64)).view(np.int64)[0]), int(batch.column("id")[row].as_py())
                if key not in seen:  # of repeated rows, one in a batch
                    seen.add(key)
                    node.append(key[0])
                    sets.append((key[1], x.tobytes()))
            if node:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sets], pa.int64()), pa.array(node, pa.int64()), pa.array([s for _, s in sets], pa.binary())], names=["id", "node", "shingles"])

    return run


_NULL_ID = (1 << 63) - 1


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set of word shingles and the smallest id that links reach.

    Two texts link when 100 * shared >= percent * united shingles. Letters A-Z
    count as a-z. A text with fewer words than a shingle has one shingle, all of
    it; one without words, or null, has none and links with nothing.

    Equal sets are one class from the start, so copies never meet in pairs.
    Tokens are ordered rarest first, by a sketch of all shingle counts of fixed
    size. A set's prefix grows from the shortest that can't miss a partner by up
    to MATCHES - 1 tokens, and a pair must then share that many more: each set
    takes the length whose postings and verifications, estimated from the
    sketch, cost least; a pair goes by the stricter of its two. Survivors are
    verified against whole sets, and a pair already in one group is not compared
    again. Long token lists are joined first through a few of their sets: what
    these verify is one component, and pairs are made between components only,
    so that a group of near copies costs about its size. What is left of a list is
    dealt in blocks: no task holds a whole list that is longer. Pairs travel
    packed, by a grid of the hashes of both sides: a large group of near copies
    spreads over all tasks, and each of its sets goes to one row and one column of
    the grid. Buckets grow in number with the postings, the filter of wanted sets
    with those.

    A null id counts as the largest id and stays null in doc_id; it never is
    another row's component_id. Repeated ids are allowed: each row has its own
    set. Empty table: empty result.
    """
    out = _grouped(docs, id_col, text_col, F.lit(0), shingle, percent)
    found = F.coalesce("component_id", "id")
    return out.select(F.when(F.col("id") != _NULL_ID, F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(found != _NULL_ID, found).alias("component_id"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near duplicates: the smallest by id, nulls last, then hash of the text, then hash of the whole row.

    Groups are of rows, not of ids: of two unrelated texts under one id both
    stay. A row without words is no near duplicate; only rows with its id and
    text are its copies. Rows of groups of one stay where they are: only those
    that a filter takes for rows of larger groups are joined with their groups.
    """
    columns = [F.col(c) for c in docs.columns]
    whole = F.xxhash64(*columns, *[c.isNull() for c in columns])
    row = F.struct("id", "hash", "row")
    group = F.coalesce("root", "node", F.xxhash64("id", "hash", F.lit("no words")))
    keyed = stored(_grouped(docs, id_col, text_col, whole, shingle, percent).select("id", "hash", "row", group.alias("group")), "keyed")
    firsts = stored(keyed.groupBy("group").agg(F.count(F.lit(1)).alias("many"), F.min(row).alias("first")).where("many > 1"), "firsts")
    shared = with_values(keyed, firsts, "group", "many", row).where("first is not null")
    shared = stored(shared.select(F.col("id").alias("_id"), F.col("row").alias("_row"), (row == F.col("first")).alias("_first")).distinct(), "shared")
    perhaps = _perhaps(*_filter_of(shared, F.xxhash64("_id", "_row")))
    rows = docs.select(F.struct(*columns).alias("_doc"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NULL_ID)).alias("_id"), whole.alias("_row"))
    rows = rows.withColumn("_perhaps", perhaps(F.xxhash64("_id", "_row")))
    # repeated rows fold before the shuffle; what the filter lets through without need is in no group of two or more
    some = rows.where("_perhaps").dropDuplicates(["_id", "_row"]).join(shared, ["_id", "_row"], "left").where("coalesce(_first, true)")
    return rows.where("not _perhaps").select("_doc.*").unionByName(some.select("_doc.*"))


def _filter_of(rows: DataFrame, hashed: Column):
    """(bits, log2 of their number) of a filter of these 64-bit hashes: 16 bits for each, up to a fixed number; beyond it, it lets more through."""
    spark = rows.sparkSession
    filter_bits = min(max((16 * rows.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    h = F.shiftrightunsigned(hashed, 64 - filter_bits)
    words = rows.select(h.alias("h")).selectExpr("h >> 6 AS w", "shiftleft(1L, CAST(h & 63 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # 2**filter_bits / 64 rows at most
    table = np.zeros(1 << filter_bits >> 6, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return spark.sparkContext.broadcast(table.tobytes()), filter_bits


def _held(bits_words, filter_bits: int, hashed: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(bits_words.value, np.uint64)
    h = hashed >> np.uint64(64 - filter_bits)
    return (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


def _perhaps(bits_words, filter_bits: int):
    """Whether the filter may hold a hash: only the hashes go to Python."""

    @F.pandas_udf("boolean")
    def perhaps(h: pd.Series) -> pd.Series:
        return pd.Series(_held(bits_words, filter_bits, h.to_numpy(np.int64).view(np.uint64)))

    return perhaps


def _grouped(docs: DataFrame, id_col: str, text_col: str, row: Column, shingle: int, percent: int) -> DataFrame:
    """(id, hash of the text, row, n, node, root, component_id) of every row: its set's fingerprint, the component that links put it in and the component's smallest id; null where there is none."""
    spark = docs.sparkSession
    bits = min(20, bucket_bits(spark, 1))
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NULL_ID)).alias("id"), F.col(text_col).cast("string").alias("text"), row.cast("bigint").alias("row"))
    slices = base.select("text").mapInArrow(_sketch_rows(shingle), "slice int, counts binary").groupBy("slice").applyInArrow(_sketch_sum, "slice int, counts binary").collect()
    empty = bytes(4 << SKETCH_BITS)
    sketch = spark.sparkContext.broadcast(b"".join(bytes(r[1]) for r in sorted(slices)) or empty)  # 4 bytes for each of 2**SKETCH_BITS classes
    rows = stored(base.withColumn("hash", F.xxhash64("text")).mapInArrow(_prefix_rows(shingle, percent, sketch), "id bigint, n bigint, node bigint, need int, tokens binary, hash bigint, row bigint"), "prefixes")
    classes = stored(rows.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("many"), F.first("n").alias("n"), F.first("need").alias("need"), F.first("tokens").alias("tokens")), "classes")
    lists = classes.select("tokens").mapInArrow(_list_rows, "slice int, counts binary").groupBy("slice").applyInArrow(_sketch_sum, "slice int, counts binary").collect()
    count = np.frombuffer(b"".join(bytes(r[1]) for r in sorted(lists)) or empty, np.uint32).astype(np.int64)
    usual = 2 * count.mean()
    dense = count > DENSE + usual
    bits = max(bits, min(20, int(count.sum() // BUCKET).bit_length()))
    many = np.maximum(1, -(-(count - int(usual)) // BLOCK)).astype(np.int32)
    blocks = spark.sparkContext.broadcast(many.tobytes())  # 4 bytes for each of 2**SKETCH_BITS classes
    flags = spark.sparkContext.broadcast(dense.tobytes())  # a byte for each

    def candidates(joined: DataFrame | None, turn: int | None = None) -> DataFrame:
        sets = classes.select("n", "node", "need", "tokens")
        sets = sets.withColumn("comp", F.col("node")) if joined is None else sets.join(joined.select("node", F.col("root").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        only = {} if turn is None else {"dense": flags, "turn": turn}
        postings = sets.mapInArrow(_posting_rows(percent, bits, blocks, **only), _POSTINGS)
        pairs = postings.groupBy("bucket", "cell").applyInArrow(_candidate_rows(percent, (bits + 1) // 2, blocks, DENSE if only else 0), _PAIRS)
        return stored(pairs.groupBy("part").applyInArrow(_required_pairs, "part int, a array<bigint>, b array<bigint>"), "pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        sides = pairs.select("part", F.explode(F.array_distinct(F.concat("a", "b"))).alias("node")).groupBy("node").agg(F.collect_set("part").alias("parts"))  # a row and a column of the grid at most
        wanted = stored(sides.join(classes.select("node", "id"), "node"), "wanted")
        live, filter_bits = _filter_of(wanted, F.xxhash64("id"))
        sets = base.select("id", "text").mapInArrow(_wanted_sets(shingle, live, filter_bits), "id bigint, node bigint, shingles binary")
        sent = sets.join(wanted, ["node", "id"]).select(F.explode("parts").alias("to_part"), "node", "shingles")
        return pairs.groupBy("part").cogroup(sent.groupBy("to_part")).applyInArrow(_verified(percent), "a bigint, b bigint")

    joined = None
    for turn in range(1, ROUNDS + 1 if dense.any() else 0):
        pairs = candidates(joined, turn)
        if pairs.isEmpty():
            break
        links = stored(verified(pairs), "links")
        if links.isEmpty():
            break
        joined = stored(components(links if joined is None else links.union(joined.select(F.col("node").alias("a"), F.col("root").alias("b")))), "joined")
    links = verified(candidates(joined))
    if joined is not None:
        links = links.union(joined.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_node = components(links)
    root = of_node.join(classes.select("node", F.col("id").alias("least")), "node")
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = root.join(least, "root").select("node", "root", F.col("component_id").alias("linked_id"))
    of_class = stored(classes.select("node", "id", "many").join(linked, "node", "left").select("node", "many", "root", F.coalesce("linked_id", "id").alias("component_id")), "of-class")
    out = rows.select("id", "hash", "row", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    return with_values(out, of_class, "node", "many", F.struct("id", "hash", "row"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=90)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 2], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r(x, y) AS (SELECT DISTINCT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, CAST(least(w.doc_id, coalesce(min(r.y), w.doc_id)) AS BIGINT) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = w.doc_id GROUP BY w.doc_id
"""
