"""Tables in the folder that all machines of the cluster share, and sizes that follow the session."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_watched: list[list[str]] = []


@contextlib.contextmanager
def tables_made():
    """The paths of the tables that are stored meanwhile."""
    made: list[str] = []
    _watched.append(made)
    try:
        yield made
    finally:
        _watched.remove(made)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove stored tables that nothing needs any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, as in tests, a temporary one that goes at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        path = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        folder = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again: what follows survives lost executors without running df again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _watched:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_bits(spark: SparkSession, factor: int = 4) -> int:
    """log2 of a number of hash buckets that grows with the session's shuffle partitions."""
    return max(6, (factor * shuffle_partitions(spark) - 1).bit_length())


#: Keys that hold more than one in so many of all rows are fewer than this.
HOT_KEYS = 1000


def with_values(rows: DataFrame, values: DataFrame, key: str, many: str, spread: Column) -> DataFrame:
    """rows with the columns of values(key, many, ...), null where a row's key is null or not there; `many` says how many rows hold a key.

    A key with more than one in HOT_KEYS of the rows is joined by broadcast, since
    fewer than HOT_KEYS can be so frequent; the others by a shuffle, in which no
    key is large. Rows without a partner there are dealt by `spread`.
    """
    names = [c for c in values.columns if c != key]
    total = values.agg(F.sum(many)).first()[0] or 0
    hot = F.col(many) * HOT_KEYS > total
    packed = values.select(F.col(key).alias("_k"), F.struct(*names).alias("_v"), hot.alias("_hot"))
    near = packed.where("_hot").select(F.col("_k").alias(key), F.col("_v").alias("_near"))
    far = packed.where("not _hot").select("_k", F.lit(0).alias("_f"), F.col("_v").alias("_far"))
    out = rows.join(F.broadcast(near), key, "left")  # fewer than HOT_KEYS rows
    free = F.col("_near").isNotNull() | F.col(key).isNull()
    out = out.withColumn("_f", F.when(free, 1).otherwise(0)).withColumn("_k", F.when(free, F.xxhash64(spread)).otherwise(F.col(key)) if dict(values.dtypes)[key] == "bigint" else F.when(free, F.hex(F.xxhash64(spread))).otherwise(F.col(key)))
    out = out.join(far, ["_k", "_f"], "left").withColumn("_v", F.coalesce("_near", "_far"))
    return out.select(*rows.columns, *[F.col("_v").getField(c).alias(c) for c in names])
