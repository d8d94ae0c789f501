"""Rows by their place: numbers in the order of files and of rows inside them, and joins of two tables by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, file_col: str, row_col: str, out: str = "position") -> DataFrame:
    """rows with their number from 0: files go by name, rows inside a file by row_col, which counts from 0 without gaps.

    Only a count for each file comes together; it gives the number of a file's
    first row. No row moves for its number but to meet its file's count.
    """
    counts = rows.groupBy(F.col(file_col).alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_file", before.alias("_start"))  # a row for each file
    return rows.join(starts, rows[file_col] == F.col("_file")).withColumn(out, F.col("_start") + F.col(row_col)).drop("_file", "_start")


def parquet_rows(spark: SparkSession, path: str, out: str = "position") -> DataFrame:
    """The rows of a Parquet table with their numbers, whatever files, row groups and tasks they lie in. Columns named _path or _row are not allowed."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    return numbered(rows, "_path", "_row", out).drop("_path", "_row")


def joined(left: DataFrame, right: DataFrame, position: str = "position", policy: str = "error") -> DataFrame:
    """Row i of left beside row i of right. Where their numbers differ, policy says what to do.

    "error" fails with both numbers, "truncate" keeps as many as the shorter has,
    "outer" keeps all, with nulls. A column of right that left has too comes as right_<name>.
    """
    if policy not in ("error", "truncate", "outer"):
        raise ValueError(f"no policy {policy}")
    if policy == "error":
        a, b = left.count(), right.count()
        if a != b:
            raise ValueError(f"{a} rows on the left and {b} on the right")
    names = {c: f"right_{c}" if c in left.columns and c != position else c for c in right.columns}
    other = right.select(*[F.col(c).alias(n) for c, n in names.items()])
    return left.join(other, position, "full" if policy == "outer" else "inner")


def mismatches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, position: str = "position") -> DataFrame:
    """(rows, matched, left_only, right_only, first_mismatch): how far two tables that are paired by place also agree in a key; nulls agree with nothing."""
    a = left.select(position, F.col(left_key).alias("_a"), F.lit(1).alias("_l"))
    b = right.select(position, F.col(right_key).alias("_b"), F.lit(1).alias("_r"))
    both = a.join(b, position, "full")
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    paired = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    n = lambda c: F.count_if(c).cast("bigint")
    return both.agg(n(F.lit(True)).alias("rows"), n(same).alias("matched"), n(F.col("_r").isNull()).alias("left_only"), n(F.col("_l").isNull()).alias("right_only"), F.min(F.when(paired & ~same, F.col(position))).alias("first_mismatch"))
