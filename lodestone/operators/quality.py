"""Checks over articles and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

EDGES = (0, 128, 256, 512, 768, 1024, 2048, 4096)


def length_stats(rows: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return rows.agg(F.round(F.avg(c), 4).alias("mean"), F.min(c).cast("bigint").alias("min"), F.max(c).cast("bigint").alias("max"), F.round(F.median(c), 4).alias("median"), F.round(F.percentile(c, 0.95), 4).alias("p95"), F.count_if(c > 512).cast("bigint").alias("over_512"), F.round(100.0 * F.count_if(c > 512) / F.count(c), 4).alias("percent_over_512"))


def histogram(rows: DataFrame, column: str, edges=EDGES) -> DataFrame:
    """(low, high, n) of every bin, empty ones too; the last is closed and what lies above it is not counted."""
    bins = rows.sparkSession.createDataFrame(list(zip(edges[:-1], edges[1:])), "low int, high int")
    c, last = F.col(column), edges[-1]
    low = F.lit(None).cast("int")
    for a, b in zip(edges[:-1], edges[1:]):
        low = F.when((c >= a) & ((c < b) | ((c == last) & (F.lit(b) == last))), a).otherwise(low)
    counts = rows.select(low.alias("low")).groupBy("low").agg(F.count(F.lit(1)).alias("n"))
    return bins.join(F.broadcast(counts.where("low is not null")), "low", "left").select("low", "high", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))  # one row for each bin


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def missing_columns(rows: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in rows.columns]


def validation_report(rows: DataFrame, parents: DataFrame, key: str, text_col: str, required: list[str]) -> DataFrame:
    """(rows, surplus_ids, orphans, mojibake, missing_columns, failed): one row, each check by aggregates."""
    base = rows.agg(F.count(F.lit(1)).alias("rows"), (F.count(key) - F.countDistinct(key)).alias("surplus_ids"), F.count_if(T.has_mojibake(F.col(text_col))).cast("bigint").alias("mojibake"))
    lone = orphans(rows, parents, key).agg(F.count(F.lit(1)).alias("orphans"))
    out = base.join(F.broadcast(lone), F.lit(True)).withColumn("missing_columns", F.lit(len(missing_columns(rows, required))).cast("bigint"))  # one row each
    return out.withColumn("failed", (F.col("surplus_ids") + F.col("orphans") + F.col("mojibake") + F.col("missing_columns")) > 0)


def index_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, document, metadata): rows fit for an index; metadata is the other columns as JSON, nulls left out."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    return docs.where(~T.is_bad_chunk(F.col(text_col))).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("document"), F.to_json(F.struct(*rest)).alias("metadata"))


def last_by_id(rows: DataFrame, order: str) -> DataFrame:
    """The last row of each article_id, or of its id where it has none, by a combining aggregate."""
    keyed = rows.withColumn("article_id", F.coalesce("article_id", "id")).where("article_id is not null")
    rest = [c for c in keyed.columns if c not in (order, "article_id")]
    last = keyed.groupBy("article_id").agg(F.max(F.struct(order, *rest)).alias("_last"))
    return last.select("article_id", "_last.*")


def empty_texts(rows: DataFrame, text_col: str) -> DataFrame:
    """Rows whose text counts as empty for an encoder."""
    return rows.where(T.sanitized(F.col(text_col)) == "[EMPTY]")


def empty_count(rows: DataFrame, text_col: str) -> DataFrame:
    """(rows, empty): how many there are, and how many texts count as empty."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(T.sanitized(F.col(text_col)) == "[EMPTY]").alias("empty"))


def facet_values(rows: DataFrame, columns: list[str], with_empty: tuple[str, ...] = ()) -> DataFrame:
    """(facet, value): each column's different values in order; blank ones only of the columns in with_empty, where a null is one."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), T.text_of(F.col(c)).alias("value")) for c in columns])).alias("x")).select("x.*")
    return each.where((F.trim("value") != "") | F.col("facet").isin(list(with_empty))).distinct().orderBy("facet", "value")


def odd_head(rows: DataFrame, text_col: str, order: list[str], n: int = 25) -> DataFrame:
    """The first n rows, by `order`, whose text begins with number debris: a look at what a filter would take."""
    return rows.where(T.looks_odd(F.col(text_col))).orderBy(*order).limit(n)


def preview(rows: DataFrame, order: list[str], width: int = 120) -> DataFrame:
    """(name, value) of the first row by `order`, one row a column, values cut to a width; null for nulls."""
    first = rows.orderBy(*order).limit(1)
    cells = [F.struct(F.lit(c).alias("name"), F.substring(F.col(c).cast("string"), 1, width).alias("value")) for c in rows.columns]
    return first.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def chunk_view(rows: DataFrame, id_col: str, section_col: str, source_col: str, index_col: str) -> DataFrame:
    """(chunk_id, section, source, text, n_words, idx): the first of the columns embed_text and text, nulls as "", the index as a whole number or -1."""
    text = next(c for c in ("embed_text", "text") if c in rows.columns)
    filled = lambda c: T.text_of(F.col(c))
    return rows.select(filled(id_col).alias("chunk_id"), filled(section_col).alias("section"), filled(source_col).alias("source"), filled(text).alias("text"), T.word_count(F.col(text)).alias("n_words"), T.plain_index(F.col(index_col)).alias("idx"))
