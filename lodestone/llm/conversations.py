"""Conversation prefix trie: every distinct beginning of the rebuilt conversations, with what its subtree holds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import radix
from .shared import shuffle_partitions, stored, with_values

#: Conversations whose heads a rebuilt one can take, and the most turns of such a head.
GROUP, HEAD = 20, 3
#: Bytes of a turn's id: an MD5 of role and text, so that 10^12 turns have no two alike by chance.
WIDTH = 16
#: Keys, and bytes of keys, of one tree; what lies over a tree's ends is merged after it.
TREE_KEYS, TREE_BYTES = 1 << 15, 1 << 25
#: Members' ids of so many neighbouring conv_ids (as a power of two) travel as one string.
ID_BITS = 12
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("int")
    one = F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("id"), words.alias("words"))
    return rows.where(F.col(conv).isNotNull()).groupBy(F.col(conv).cast("bigint").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def head_of(conv: Column) -> Column:
    """How many turns a conversation takes from the first one of its group."""
    return (F.crc32(conv.cast("string").cast("binary")) % (HEAD + 1)).cast("int")


def rebuilt(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, key, words) of every conversation: its turns' ids, WIDTH bytes each, one behind the other, and their words.

    Turns go by `turn`, nulls first; equal ones by the MD5 of role and text.
    Rows without a conv_id belong to no conversation. Only ids of turns leave
    the scan, no texts; the ids of one conversation make one value.
    """
    own = _turns(rows, conv, turn, role, text).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    heads = _turns(rows.where(F.col(conv) % GROUP == 0), conv, turn, role, text).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD).alias("head"))
    h = head_of(F.col("conv_id"))
    taken = F.when(h > 0, F.slice(F.coalesce("head", F.array().cast(own.schema["turns"].dataType)), F.lit(1), F.greatest(h, F.lit(1)))).otherwise(F.array())
    kept = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    all_turns = own.join(heads, "base", "left").select("conv_id", F.concat(taken, kept).alias("turns"))
    return all_turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


_FOLDED = "digest string, key binary, words array<int>, n bigint, conv_id bigint, ends string"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of blocks sorted by key and place: the hash runs over the blocks as they come, none is kept."""
    current, hashed, n, first = None, None, 0, None
    out: list[tuple] = []

    def taken() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pylist([dict(zip(("digest", "key", "words", "n", "conv_id", "ends"), r)) for r in out], schema=pa.schema([("digest", pa.string()), ("key", pa.binary()), ("words", pa.list_(pa.int32())), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())]))
        out.clear()
        return made

    for batch in batches:
        digests, ids, counts, mins = (batch.column(c).to_pylist() for c in ("digest", "ids", "n", "conv_id"))
        keys, words = batch.column("key"), batch.column("words")
        for i, digest in enumerate(digests):
            if digest != current:
                if current is not None:
                    out.append((current, *first, n, conv, hashed.hexdigest()))
                current, hashed, n, first, conv = digest, hashlib.sha256(), 0, (keys[i].as_py(), words[i].as_py()), mins[i]
            else:
                hashed.update(b",")
            hashed.update(ids[i].encode())
            n += counts[i]
        if len(out) >= 4096:
            yield taken()
    if current is not None:
        out.append((current, *first, n, conv, hashed.hexdigest()))
    yield taken()


def folded(conversations: DataFrame) -> DataFrame:
    """Each distinct key once: (digest, key, words, n members that end there, their smallest conv_id, hash of all of them).

    Members' ids are first joined in blocks of neighbouring ids, so that a key that a third of all
    conversations share sends one row for thousands of them; SHA-256 takes the blocks one after the other.
    """
    block = conversations.select(F.md5("key").alias("digest"), F.shiftright("conv_id", ID_BITS).alias("block"), "conv_id", "key", "words")
    block = block.groupBy("digest", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("key").alias("key"), F.first("words").alias("words"))
    return block.repartition("digest").sortWithinPartitions("digest", "block").mapInArrow(_ends, _FOLDED)


_NODE = "node string, depth bigint, conv_id bigint, parent string, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, ends string"
_NODE_ARROW = pa.schema([(c, pa.string() if t == "string" else pa.int64()) for c, t in (x.split() for x in _NODE.split(", "))])


def _walked(keys: list[bytes], words: pa.Array, many: list[int], convs: list[int], ends: list[str]) -> pa.RecordBatch:
    """The trie nodes of sorted keys. A node that holds neither the first nor the last key has all its members here, and its subtree too; the others are named by `node` and told in parts."""
    last, counts = len(keys) - 1, words.flatten().to_pylist()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).tolist()
    found = radix.nodes(radix.tree(keys))
    total, least, low, high, kids, leaves, saved = ([x] * len(found) for x in (0, None, last, 0, 0, 0, 0))
    waiting: list[list | None] = [None] * len(found)
    out: dict[str, list] = {c: [] for c in _NODE_ARROW.names}
    columns = [out[c] for c in _NODE_ARROW.names]

    def put(row: list) -> None:
        for column, value in zip(columns, row):
            column.append(value)

    for place in range(len(found) - 1, -1, -1):
        node, before, depth, parent = found[place]
        n, conv, lo, hi, k, leaf, gain, wait = total[place], least[place], low[place], high[place], kids[place], leaves[place], saved[place], waiting[place] or []
        if node.end >= 0:
            e = node.end
            n, conv, lo, hi = n + many[e], convs[e] if conv is None else min(conv, convs[e]), min(lo, e), max(hi, e)
        edge = lo == 0 or hi == last
        for at in range(depth // WIDTH * WIDTH, before, -WIDTH):
            d = at // WIDTH
            own = ends[node.end] if at == depth and node.end >= 0 else None
            word = counts[offsets[lo] + d - 1] if d else 0
            if edge:
                name = hashlib.md5(keys[lo][:at]).hexdigest()
                for row in wait:
                    row[3] = name
                    put(row)
                put([name, d, conv, hashlib.md5(keys[lo][: at - WIDTH]).hexdigest() if d else None, None, n, k, leaf, gain, word, own])
                wait, k, leaf, gain = [], 0, 0, 0  # the path above takes them from this node's own row
            else:
                leaf += k == 0
                gain += (n - 1) * word
                for row in wait:
                    row[4] = conv
                    put(row)
                wait, k = [[None, d, conv, None, None, n, k, leaf, gain, word, own]], 1
        if parent >= 0:
            total[parent] += n
            least[parent] = conv if least[parent] is None else min(least[parent], conv)
            low[parent], high[parent] = min(low[parent], lo), max(high[parent], hi)
            kids[parent] += k
            leaves[parent] += leaf
            saved[parent] += gain
            if wait:
                if waiting[parent] is None:
                    waiting[parent] = wait
                else:
                    waiting[parent] += wait
    return pa.RecordBatch.from_pydict(out, schema=_NODE_ARROW)


def _grown(tree_keys: int, tree_bytes: int):
    """Trees over the sorted keys of one partition, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def grown() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            return _walked(t.column("key").to_pylist(), t.column("words").combine_chunks(), *(t.column(c).to_pylist() for c in ("n", "conv_id", "ends")))

        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                held.append(batch)
                rows, size = rows + len(batch), size + batch.column("key").nbytes
                if rows >= tree_keys or size >= tree_bytes:
                    yield grown()
                    held, rows, size = [], 0, 0
        if rows:
            yield grown()

    return run


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes over the ends of trees, deepest first, each with what lies under it added up."""
    table = pa.Table.from_batches(batches, schema=_NODE_ARROW)
    rows = {r["node"]: r for r in table.to_pylist()}
    for r in sorted(rows.values(), key=lambda r: -r["depth"]):
        above = rows.get(r["parent"])
        r["n_leaves"] += r["n_children"] == 0
        r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
        if above:
            r["parent_conv_id"] = above["conv_id"]
            above["n_children"] += 1
            above["n_leaves"] += r["n_leaves"]
            above["saved_tokens"] += r["saved_tokens"]
    if rows:
        yield pa.RecordBatch.from_pylist(list(rows.values()), schema=_NODE_ARROW)


def trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tree_keys: int = TREE_KEYS, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations (see `rebuilt`), the textless root among them.

    (conv_id: smallest member, depth, parent_conv_id: the parent's, n_convs,
    n_children, n_leaves and saved_tokens of its subtree, ends_sha256 of the
    members that end there.) Members are the rebuilt conversations that begin
    so; one without turns belongs to the root.

    Equal conversations fold into one key first. Keys are sorted over the
    cluster; every task builds adaptive radix trees over a run of them, and only
    byte depths at a turn's end make nodes. A node that reaches over the first
    or last key of a tree (at most two paths a tree) is told in parts that are
    added up after it; the paths alone, not their members, meet in one task.
    Null roles and texts are empty, null conv_ids are left out, repeated rows
    are turns of their own, other columns are ignored. Empty table: no rows.
    """
    keys = stored(folded(rebuilt(rows, conv, turn, role, text)), "conversation-keys")
    spread = keys.repartitionByRange(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    found = stored(spread.mapInArrow(_grown(tree_keys, tree_bytes), _NODE), "conversation-nodes")
    parts = found.where("node is not null").groupBy("node").agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), F.lit(None).cast("bigint").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("words").alias("words"), F.max("ends").alias("ends"))
    closed = stored(parts.select(*_NODE_ARROW.names).repartition(1).mapInArrow(_closed, _NODE), "conversation-paths")
    whole = found.where("node is null").drop("node")
    above = closed.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"), F.col("n_children").alias("fan"))
    whole = with_values(whole, above, "parent", "fan", F.struct("conv_id", "depth")).withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")]
    return whole.select(*kept).unionAll(closed.select(*kept))


def query(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: In DuckDB: CRC-32 by its bits, beginnings as lists of MD5s, subtrees by every node's ancestors.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS nth FROM t),
c AS (SELECT DISTINCT conv_id, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, x: list_reduce(list_concat([xor(a, x)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: xor(s >> 1, (s & 1) * 3988292384))) AS crc FROM t),
h AS (SELECT conv_id, xor(crc, 4294967295) % 4 AS h, conv_id - conv_id % 20 AS base FROM c),
m AS (SELECT h.conv_id, r.nth AS place, id, words FROM h JOIN r ON r.conv_id = h.base AND nth <= h UNION ALL SELECT h.conv_id, h + nth, id, words FROM h JOIN r ON r.conv_id = h.conv_id AND nth > h),
k AS (SELECT conv_id, list(id ORDER BY place) AS ids, list(words ORDER BY place) AS words FROM m GROUP BY conv_id),
a AS (SELECT h.conv_id, coalesce(ids, []) AS ids, coalesce(words, []) AS words FROM h LEFT JOIN k USING (conv_id)),
p AS (SELECT conv_id, d AS depth, ids[1:d] AS node, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS word, len(ids) = d AS ended FROM a, unnest(generate_series(0, len(ids))) AS g(d)),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(word) AS word, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ends FROM p GROUP BY node, depth),
q AS (SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN n u ON n.depth > 0 AND u.node = n.node[1:n.depth - 1]),
f AS (SELECT u.node, count(*) AS n_children FROM n JOIN n u ON n.depth > 0 AND u.node = n.node[1:n.depth - 1] GROUP BY u.node),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN f USING (node)),
s AS (SELECT w.node[1:d] AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * word) AS saved_tokens FROM w, unnest(generate_series(0, depth)) AS g(d) GROUP BY 1)
SELECT q.conv_id, q.depth::BIGINT AS depth, q.parent_conv_id, q.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(q.ends) AS ends_sha256
FROM q JOIN w USING (node) JOIN s USING (node)
"""
