"""Near duplicates among embeddings: every pair of a group, in tiles whose blocks are skipped where none can link."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import shuffle_partitions, stored, with_values

SIMILARITY, BITS, NEIGHBORS = 0.93, 32, 2048
#: Components of vectors, about, on a side of a tile: 65,536 vectors of 64.
SIDE = 1 << 22
#: Vectors that a block meets at a time, and pairs that are told in double precision at a time.
MEET, TELL = 1024, 1 << 16
#: The share of pairs just at the similarity that the passes of `passes_of` may miss.
MISS = 0.01


def passes_of(x: np.ndarray, mean: np.ndarray, n: int, similarity: float, neighbors: int, miss: float = MISS, most: int = 1 << 14) -> int:
    """Passes that a search in sorted windows would take over a group of n unit vectors, of which x are some, to miss pairs just at the similarity with that rate.

    `near_duplicates` misses none and makes no such passes; this tells how a group lies.

    Hyperplanes go through the group's mean; two vectors at an angle as seen from
    there agree in a random one's sign with 1 - angle / pi. A vector's crowd, those
    that agree with it in b signs, falls to a window's size at some b, which
    depends on how the others lie about it: in one cloud, in clusters, or evenly.
    A pair meets in a pass if it agrees in that many.
    """
    r = x - mean
    squares = np.maximum((r * r).sum(axis=1), 1e-12)
    u = r / np.sqrt(squares)[:, None]
    agree = 1 - np.arccos(np.clip(u @ u.T, -1, 1)) / math.pi
    np.fill_diagonal(agree, 0)
    logs = np.log(np.maximum(agree, 1e-12))
    scale = (n - 1) / max(1, len(x) - 1)
    low, high = np.zeros(len(x)), np.full(len(x), 64.0)
    for _ in range(30):
        middle = (low + high) / 2
        crowd = scale * np.exp(logs * middle[:, None]).sum(axis=1)
        low, high = np.where(crowd > neighbors, middle, low), np.where(crowd > neighbors, high, middle)
    pair = 1 - np.arccos(np.clip(1 - (1 - similarity) / squares, -1, 1)) / math.pi
    meet = np.maximum(pair, 1e-12) ** high
    few, many = 1, 2
    while many < most and ((1 - meet) ** many).mean() > miss:
        few, many = many, 2 * many
    while many - few > 1:
        p = (few + many) // 2
        few, many = (p, many) if ((1 - meet) ** p).mean() > miss else (few, p)
    return many


def _united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent, a root for each place, after the links a-b."""
    while True:
        x, y = parent[a], parent[b]
        some = x != y
        if not some.any():
            return parent
        a, b, x, y = a[some], b[some], x[some], y[some]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above


def _blocks(x: np.ndarray, bits: int, most: int) -> list[np.ndarray]:
    """Places of vectors in blocks of at most so many that lie close together: cut by hyperplanes through the mean, across the longest axis, up to `bits` times in a row."""
    done, open_ = [], [(np.arange(len(x)), bits)]
    while open_:
        part, left = open_.pop()
        if len(part) <= most or not left:
            done += [part[k : k + most] for k in range(0, len(part), most)]
            continue
        y = x[part] - x[part].mean(axis=0)
        axis = y[np.argmax((y * y).sum(axis=1))]
        for _ in range(4):
            axis = y.T @ (y @ axis)
            axis /= max(1e-30, np.linalg.norm(axis))
        sign = y @ axis >= 0
        open_ += [(part[~sign], left - 1), (part[sign], left - 1)] if sign.any() and not sign.all() else [(part, 0)]
    return done


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one length as they are, and as unit vectors in single precision."""
    raw = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    unit = np.empty(raw.shape, np.float32)
    for at in range(0, len(raw), MEET):
        x = raw[at : at + MEET].astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        unit[at : at + MEET] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return raw, unit


def _reached(u: np.ndarray, v: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows' cosines reach the similarity, in double precision.

    Sums go by the order of components, so a pair has one answer whatever else is
    asked with it. Scaling by powers of two keeps squares in range and is exact.
    """
    u, v = (np.ascontiguousarray(np.ldexp(w.T, -np.frexp(np.abs(w).max(axis=1))[1])) for w in (u.astype(np.float64), v.astype(np.float64)))
    dot, uu, vv = np.zeros((3, u.shape[1]))
    for a, b in zip(u, v):
        dot, uu, vv = dot + a * b, uu + a * a, vv + b * b
    return dot / (np.sqrt(uu) * np.sqrt(vv)) >= similarity


def _linked(raw: np.ndarray, x: np.ndarray, ends: list[int], inside: bool, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All linked pairs of places, each once: of the blocks that end there with all behind the last, or with `inside` all pairs.

    A block lies in a ball; vectors farther from its centre than radius and reach
    together can't link with any of it and are left out. Products in single
    precision that could be on either side of the similarity are told in double
    precision.
    """
    slack = (x.shape[1] + 8) * 2.0**-23  # twice the bound of single precision's error in a product
    reach = math.sqrt(max(0.0, 2 - 2 * similarity))
    for at, end in zip([0, *ends], ends):
        part, first = x[at:end], at if inside else ends[-1]
        centre = part.mean(axis=0)
        squares = lambda v: 1 + float(centre @ centre) - 2 * (v @ centre)
        radius = math.sqrt(max(0.0, float(squares(part).max())) + 4 * slack)
        others = first + np.flatnonzero(squares(x[first:]) <= (radius + reach) ** 2 + 4 * slack)
        for to in range(0, len(others), MEET):
            cols = others[to : to + MEET]
            close = (part @ x[cols].T).ravel()
            some = np.flatnonzero(close >= similarity - slack)
            i, j = np.divmod(some, len(cols))
            a, b, told = i + at, cols[j], close[some] >= similarity + slack
            if inside:
                once = a < b
                a, b, told = a[once], b[once], told[once]
            open_ = np.flatnonzero(~told)
            for k in range(0, len(open_), TELL):
                ask = open_[k : k + TELL]
                told[ask] = _reached(raw[a[ask]], raw[b[ask]], similarity)
            if told.any():
                yield a[told], b[told]


def _tile_links(similarity: float, bits: int, block: int):
    """What the groups of one part, or two sides of one group, show: (node, links, up) of each vector with a link, its links counted in rows of the table, `up` one vector for all that are linked together."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table, i, j = table.sort_by("grp"), key[1].as_py(), key[2].as_py()
        grp, node, many, side = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("grp", "node", "many", "side"))
        lists = table.column("vec").combine_chunks()
        up, links = node.copy(), np.zeros(len(node), np.int64)
        bounds = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1], [True]]))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            raw, x = _vectors(lists.slice(lo, hi - lo))
            left, right = np.flatnonzero(side[lo:hi] == i), np.flatnonzero(side[lo:hi] != i)
            blocks = _blocks(x[left], bits, block)
            order = np.concatenate([*(left[k] for k in blocks), right])
            raw, x, at = raw[order], x[order], order + lo
            parent, copies = np.arange(hi - lo), many[at]
            for a, b in _linked(raw, x, np.cumsum([len(k) for k in blocks]).tolist(), i == j, similarity):
                parent = _united(parent, a, b)
                for s, t in ((a, b), (b, a)):
                    links[at] += np.bincount(s, copies[t], hi - lo).astype(np.int64)
            up[at] = node[at[parent]]
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "links": links[some], "up": up[some]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", similarity: float = SIMILARITY, bits: int = BITS, neighbors: int = NEIGHBORS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; only vectors of one group are compared, by cosine.

    Equal vectors of a group are one class from the start. All pairs of classes
    of a group are compared, whatever its size: groups are dealt in sides of about
    SIDE components, and every two sides meet in one task, small groups many in
    one. There a side is cut in blocks of `neighbors` vectors at most, by up to
    `bits` hyperplanes one after the other; a block meets the vectors that can
    link with any of it. No link is lost and none is found below the similarity,
    and neither sizes, `bits` nor `neighbors` change a result. The work
    grows with the square of a group, less what blocks leave out; a vector
    travels once for each side of its group.

    Vectors that are null, empty, zero or hold null or non-finite values, and
    rows with a null group, link with nothing. Vectors of different lengths are
    never compared. Null ids stay null and count as the largest. Repeated rows
    are rows of their own and link with each other. Empty table: empty result.
    """
    spark, most_id = vectors.sparkSession, (1 << 63) - 1
    vec = F.col(vector_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col(group_col).isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(most_id)).alias("id"), F.when(sound, F.xxhash64(F.col(group_col), vec)).alias("node"), F.xxhash64(F.col(group_col), F.size(vec)).alias("grp"), F.when(sound, F.col(vector_col)).alias("vec"))
    rows = stored(rows, "vectors")
    classes = stored(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many"), F.first("grp").alias("grp"), F.first("vec").alias("vec")), "classes")
    sizes = stored(classes.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.first(F.size("vec")).alias("dim")), "sizes")

    parts = 4 * max(shuffle_partitions(spark), (sizes.agg(F.sum(F.col("size") * F.col("dim"))).first()[0] or 0) // SIDE)
    dealt = with_values(classes.select("grp", "node", "many", "vec"), sizes, "grp", "size", F.col("node")).where("size > 1")
    dealt = dealt.withColumn("sides", F.ceil(F.col("size") * F.col("dim") / SIDE).cast("int"))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    part = F.when(F.col("sides") > 1, parts + F.pmod(F.col("grp"), F.lit(1 << 40))).otherwise(F.pmod(F.xxhash64("grp"), F.lit(parts)))
    dealt = dealt.select(part.alias("part"), F.least("side", "t").alias("i"), F.greatest("side", "t").alias("j"), "grp", "node", "many", "side", "vec")
    shown = stored(dealt.groupBy("part", "i", "j").applyInArrow(_tile_links(similarity, bits, neighbors), "node bigint, links bigint, up bigint"), "links")

    of_node = stored(components(shown.select(F.col("node").alias("a"), F.col("up").alias("b"))), "components")
    least = of_node.join(classes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("m"))
    linked = with_values(of_node, stored(least, "roots"), "root", "m", F.col("node")).select("node", "component")
    links = shown.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "least", "many").join(links, "node", "left").join(linked, "node", "left")
    known = stored(known.select("node", "many", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "least").alias("component")), "known")
    out = with_values(rows.select("id", "node"), known, "node", "many", F.col("id")).select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component"))
    real = lambda c: F.when(F.col(c) != most_id, F.col(c))
    return out.select(real("id").alias("vec_id"), "n_links", real("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN k ON k.x = vec_id
"""
