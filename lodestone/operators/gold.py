"""A reviewed question set as an append-only edit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def last_edits(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key, by a combining aggregate: a key with most of the log gathers nowhere."""
    rest = [c for c in log.columns if c not in order]
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c != key])).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in log.columns if c != key])


def merged(gold: DataFrame, edits: DataFrame, texts: list[str], ids: str | None = None) -> DataFrame:
    """gold with each row's last edit: texts that are neither blank nor "manual" replace, ids replace when not null, even empty."""
    e = edits.select("id", *[F.col(c).alias(f"_{c}") for c in texts], *([F.col(ids).alias("_ids")] if ids else []))
    out = gold.join(e, "id", "left")
    for c in texts:
        v = F.trim(F.col(f"_{c}"))
        out = out.withColumn(c, F.when(v.isNotNull() & (v != "") & (F.lower(v) != "manual"), v).otherwise(F.col(c)))
    if ids:
        out = out.withColumn(ids, F.coalesce("_ids", ids))
    return out.select(*gold.columns)


def searched(gold: DataFrame, pattern: str | None = None, topic: str | None = None, buckets: list[str] | None = None) -> DataFrame:
    out = gold
    if topic:
        out = out.where(F.col("topic") == topic)
    if buckets:
        out = out.where(F.col("bucket").isin(buckets))
    return out.where(F.col("question").rlike("(?i)" + pattern)) if pattern else out


def page(gold: DataFrame, order: list[str], size: int = 50, number: int = 1) -> DataFrame:
    """One page of the ordered rows, numbered from 1. A display feature: offset and limit of a total order."""
    return gold.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def of_article(chunks: DataFrame, source_col: str, source: str, order: list[str]) -> DataFrame:
    """One article's chunks in order; rows of no source belong to none."""
    return chunks.where(F.col(source_col) == source).orderBy(*order)


def added(existing: Column, new: Column) -> Column:
    return F.array_union(existing, new)


def removed(existing: Column, gone: Column) -> Column:
    return F.filter(existing, lambda x: ~F.array_contains(gone, x))


def saved(selected: Column, current: Column, of_article: Column) -> Column:
    """An article's ids replaced by the selected ones; ids of other articles stay behind them."""
    return F.concat(selected, F.filter(current, lambda x: ~F.array_contains(of_article, x)))


def ordered_by_index(ids: DataFrame, index: DataFrame) -> DataFrame:
    """ids(key, pos, id) in the order of index(id, idx), unknown ids behind in input order: (key, ids)."""
    rows = ids.join(index, "id", "left")
    item = F.struct(F.col("idx").isNull().alias("unknown"), F.coalesce("idx", F.lit(0)).alias("i"), "pos", "id")
    return rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["id"]).alias("ids"))


def question_table(gold: DataFrame, id_col: str, text_col: str, ids_col: str) -> DataFrame:
    """Questions numbered from 1 by a whole-number id, with their first id ("" without one) and the number of ids.

    Up to 64 quantiles of the ids cut the rows into ranges that are numbered each
    by itself; only the ranges' counts come together.
    """
    ids = F.coalesce(ids_col, F.array().cast(gold.schema[ids_col].dataType))
    rows = gold.where(F.col(id_col).isNotNull()).select(id_col, F.trim(T.text_of(F.col(text_col))).alias("question"), F.coalesce(F.get(ids, F.lit(0)).cast("string"), F.lit("")).alias("first_id"), F.size(ids).cast("bigint").alias("n_ids"))
    cuts = sorted(set(gold.agg(F.percentile_approx(id_col, [i / 64 for i in range(1, 64)])).first()[0] or []))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(id_col))) if cuts else F.lit(0)
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    start = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(id_col, "question", "first_id", "n_ids"))
    return rows.withColumn("_row", inside).join(F.broadcast(start), "_part").select(id_col, (F.col("_start") + F.col("_row")).alias("number"), "question", "first_id", "n_ids")  # at most 64 rows


def with_topics(gold: DataFrame, known: DataFrame) -> DataFrame:
    """gold with topic and bucket from known(question, topic, bucket) by the question's text, trimmed; blank ones only, and "" where nothing is known.

    Of several known rows of a question the smallest topic and bucket count.
    """
    one = known.select(F.trim("question").alias("_q"), F.struct("topic", "bucket").alias("_k")).groupBy("_q").agg(F.min("_k").alias("_k"))
    out = gold.withColumn("_q", F.trim("question")).join(one, "_q", "left")
    for c in ("topic", "bucket"):
        out = out.withColumn(c, F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col("_k").getField(c), F.lit("")))
    return out.select(*gold.columns)


def dangling(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, id) of ids(key, id) that no row of chunks(id) has."""
    return ids.where("id is not null").select("key", "id").distinct().join(chunks.select("id").distinct(), "id", "left_anti").select("key", "id")


def added_in_order(ids: DataFrame, new: DataFrame, index: DataFrame) -> DataFrame:
    """ids(key, pos, id) with new(key, pos, id) behind them, each id once, in the order of index(id, idx): (key, ids)."""
    both = ids.select("key", F.lit(0).alias("_of"), "pos", "id").union(new.select("key", F.lit(1).alias("_of"), "pos", "id"))
    first = both.groupBy("key", "id").agg(F.min(F.struct("_of", "pos")).alias("pos"))
    return ordered_by_index(first, index)
