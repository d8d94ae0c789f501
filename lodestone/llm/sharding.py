"""Sharding through a fixed number of virtual slots and a versioned map from slots to shards."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

SLOTS, SHARDS, ROW_BYTES = 8192, 40, 16


#: A row that is there more than once is dealt copy by copy if it has more than one in so many of a slot's share of all rows.
SHARE = 4


def dealt(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """rows(key, at, ...), where key is a hash of id and text, with their virtual slot: by key, so that an id in many rows fills no slot of its own.

    Rows equal in id and text that would fill one are dealt by their place `at`;
    there are fewer than SHARE * slots such keys, which bounds the broadcast.
    """
    total = rows.count()
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & (F.col("_n") * SHARE * slots > total)).select("key", F.lit(True).alias("_many"))
    place = F.when(F.col("_many"), F.xxhash64("key", "at")).otherwise(F.col("key"))
    return rows.join(F.broadcast(many), "key", "left").withColumn("virtual_slot", F.pmod(place, F.lit(slots)).cast("int")).drop("_many", "key", "at")


def rebalanced(shard_of: list[int], sizes: list[int], shards: int) -> list[int]:
    """An edited map with near-equal bytes: slots move from the fullest shard to the emptiest as long as that evens them out.

    New shards start empty and take slots only from others; slots of shards that
    are no longer there move first. Nothing else moves.
    """
    new = list(shard_of)
    load, held = [0] * shards, [[] for _ in range(shards)]
    homeless = []
    for slot, s in enumerate(new):
        if s < shards:
            load[s] += sizes[slot]
            held[s].append(slot)
        else:
            homeless.append(slot)
    heap = [(x, s) for s, x in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda x: (-sizes[x], x)):
        x, s = heapq.heappop(heap)
        new[slot] = s
        held[s].append(slot)
        load[s] = x + sizes[slot]
        heapq.heappush(heap, (load[s], s))
    stuck: set[int] = set()
    for _ in range(4 * len(new)):
        full = max((s for s in range(shards) if s not in stuck), key=lambda s: (load[s], -s), default=None)
        empty = min(range(shards), key=lambda s: (load[s], s))
        if full is None or load[full] <= load[empty]:
            break
        gap = load[full] - load[empty]
        slot = min((x for x in held[full] if 0 < sizes[x] < gap), key=lambda x: (abs(2 * sizes[x] - gap), x), default=None)
        if slot is None:
            stuck.add(full)
            continue
        stuck.discard(empty)
        held[full].remove(slot)
        held[empty].append(slot)
        new[slot] = empty
        load[full] -= sizes[slot]
        load[empty] += sizes[slot]
    return new


def slot_map(spark, sizes: DataFrame, shards: int, slots: int = SLOTS, earlier: DataFrame | None = None) -> DataFrame:
    """(version, slot, shard), stored: the earlier map's latest version, or an even deal, edited for sizes(slot, bytes) and this number of shards.

    One row for each of the fixed slots reaches the driver, at any size of the
    data; older versions are carried on as they are.
    """
    by_slot = {r[0]: r[1] for r in sizes.select("slot", "bytes").collect()}
    weight = [by_slot.get(s, 0) for s in range(slots)]
    if earlier is None:
        old, version = [s % shards for s in range(slots)], 0
        earlier = spark.createDataFrame([(0, s, x) for s, x in enumerate(old)], "version int, slot int, shard int")
    else:
        newest = earlier.join(earlier.agg(F.max("version").alias("version")), "version").select("version", "slot", "shard").collect()
        version = newest[0][0]
        old = [x for _, x in sorted((r[1], r[2]) for r in newest)]
    rows = [(version + 1, s, x) for s, x in enumerate(rebalanced(old, weight, shards))]
    return stored(earlier.select("version", "slot", "shard").union(spark.createDataFrame(rows, "version int, slot int, shard int")).coalesce(1), "slot-map")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS, earlier: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, size, text_crc32, virtual_slot, shard, slot) of every row, the map with all its versions).

    A row's virtual slot is a hash of its id and text; bytes are summed by slot, and the
    map is edited until the shards' bytes are near equal. `slot` numbers the
    rows of a shard without gaps: by virtual slot and, in it, by id. The
    numbering sorts each virtual slot by itself, so no task sorts a whole shard.

    Null text has no bytes but the row's own; a null id goes by its text. Equal
    texts under different ids are rows like any others and can go to different
    shards: sizes near equal is the law, and a group of copies may hold a third of
    all bytes. Rows equal in id and text share a slot, or are spread where they would
    fill it (`dealt`). Other columns are ignored. Empty table: empty result and an even map.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.col(id_col).cast("bigint")
    rows = docs.select(ident.alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(ident, text).alias("key"), F.monotonically_increasing_id().alias("at"))
    rows = stored(dealt(stored(rows, "keyed"), slots), "sized")
    sums = stored(rows.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "slot-bytes")
    maps = slot_map(docs.sparkSession, sums, shards, slots, earlier)
    newest = maps.join(maps.agg(F.max("version").alias("version")), "version")
    in_shard = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = newest.join(sums, "slot", "left").select(F.col("slot").alias("virtual_slot"), "shard", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(in_shard), F.lit(0)).alias("begin"))
    nth = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("nth", nth)
    out = numbered.join(F.broadcast(begins), "virtual_slot").select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("begin") + F.col("nth") - 1).cast("bigint").alias("slot"))  # begins: one row for each of the fixed slots
    return out, maps


def query(spark, sf_dir: str) -> DataFrame:
    out, _ = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
