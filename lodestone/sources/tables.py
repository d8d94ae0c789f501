"""Readers and writers: Parquet, tolerant and strict JSON lines, CSV, versioned and appended tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


from .paths import exists


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or JSON lines, by suffix."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".jsonl", ".json")):
        return spark.read.json(path)
    raise ValueError(f"neither .parquet nor .jsonl: {path}")


def tolerant_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(readable records, lines that aren't)."""
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("r")).select("r.*")
    return rows.where("_bad is null").drop("_bad"), rows.where("_bad is not null").select("_bad")


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of which one that can't be read fails the job; blank lines are none, and a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def decoded(content: Column) -> Column:
    """The text of bytes: UTF-8 where they are that, without its mark, else Latin-1, in which every byte is a letter."""
    raw = content.cast("string")
    return F.when(F.is_valid_utf8(raw), F.regexp_replace(raw, "^\ufeff", "")).otherwise(F.decode(content, "ISO-8859-1"))


def html_files(spark: SparkSession, root: str, pattern: str = "index*", guess: bool = False) -> DataFrame:
    """(path, html) of the page files under a folder; with guess, pages that are no UTF-8 are read in the charset that they seem to have."""
    from ..functions import charsets
    from ..functions.html import SKIPPED_PATHS, sniffed

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = files.where(~F.col("path").rlike(SKIPPED_PATHS)).select("path", (charsets.decoded if guess else decoded)(F.col("content")).alias("html"))
    return rows.where(sniffed(F.col("html")))


def save(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A table in one commit; without overwrite an existing one is an error."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def without_id(log: DataFrame, key: str, value: str) -> DataFrame:
    """A log without one id's records, to be written as a new version."""
    return log.where(F.col(key).isNull() | (F.col(key) != value))


def save_version(df: DataFrame, root: str, version: int) -> None:
    """A new version of a table; the older ones stay as backups and an existing one is an error."""
    df.write.mode("errorifexists").parquet(f"{root}/version={version}")


def latest_version(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of a table written by save_version."""
    rows = spark.read.parquet(root)
    newest = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == newest).drop("version")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all machines share, as spark.checkpoint.dir names it; where that is unset, as in tests, in a temporary one that goes at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        path = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        root = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table_or_none(spark: SparkSession, folder: str, *names: str) -> DataFrame | None:
    """The first of the named tables that Spark can open in a folder."""
    for n in names:
        try:
            return chunks_table(spark, f"{folder}/{n}")
        except AnalysisException:  # no such path
            continue
    return None


#: One record of the session log.
SESSION_RECORD = "ts double, q string, answer string, retrieval_time double, generation_time double, prompt_tokens int, output_tokens int, context_tokens int, question_tokens int, citations array<string>, contexts_meta array<struct<src: string, sec: string>>"


def log_answers(answers: DataFrame, path: str) -> None:
    """Answers appended to a session log, in its columns; those that they lack are null."""
    record = StructType.fromDDL(SESSION_RECORD)
    append_json(answers.select(*[(F.col(f.name) if f.name in answers.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in record]), path)


def build_and_save(articles: DataFrame, chunks: DataFrame, folder: str, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """Articles and chunks checked, chunks deduplicated by body, articles without chunks dropped, both sorted and written; read back.

    Chunks in order of source and place, of equal bodies the first; without any
    chunk nothing is written and it is an error. Existing tables are one as well, unless overwritten.
    """
    from ..operators.chunking import dedup_near_exact

    if chunks.isEmpty():
        raise ValueError("no chunks")
    spark = chunks.sparkSession
    save(dedup_near_exact(chunks, "body", ["source_relpath", "article_seq"]).orderBy("source_relpath", "article_seq"), f"{folder}/chunks.parquet", overwrite)
    kept = spark.read.parquet(f"{folder}/chunks.parquet")
    with_chunks = articles.join(chunks.select("article_id").distinct(), "article_id", "left_semi")
    save(with_chunks.orderBy("url"), f"{folder}/articles.parquet", overwrite)
    return spark.read.parquet(f"{folder}/articles.parquet"), kept


def create_index(docs: DataFrame, vectors: DataFrame, path: str, id_col: str, text_col: str, vector_col: str = "embedding", overwrite: bool = False) -> int:
    """The rows fit for an index with their vectors, joined by id, as a table (id, document, metadata, embedding); how many there are."""
    from ..operators.quality import index_rows

    rows = index_rows(docs, id_col, text_col).join(vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("embedding")), "id")
    save(rows, path, overwrite)
    return rows.sparkSession.read.parquet(path).count()


def open_index(spark: SparkSession, path: str, docs: DataFrame, vectors: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The index at a path, built there first where it isn't."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        create_index(docs, vectors, path, id_col, text_col)
        return spark.read.parquet(path)
