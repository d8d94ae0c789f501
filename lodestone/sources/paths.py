"""Where tables and pages lie: looks at names only, in any store that Spark opens."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place) and store.getFileStatus(place).isDirectory()


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder, by name."""
    store, place = _store(spark, path)
    return sorted(f.getPath().toString() for f in store.listStatus(place) if f.isDirectory())


def chunks_path(spark: SparkSession, path: str) -> str:
    """The chunks' table for a path: itself; in a folder that is no table itself chunks.parquet or else chunks.jsonl; for one that isn't there the same name with the other suffix.

    FileNotFoundError names what was tried.
    """
    stem, suffix = os.path.splitext(path.rstrip("/"))
    if is_folder(spark, path) and suffix.lower() not in (".parquet", ".jsonl", ".json"):
        tried = [f"{path.rstrip('/')}/chunks.parquet", f"{path.rstrip('/')}/chunks.jsonl"]
    elif suffix.lower() in (".jsonl", ".json"):
        tried = [path, f"{stem}.parquet"]
    else:
        tried = [path, f"{stem}.jsonl"] if suffix.lower() == ".parquet" else [path]
    for p in tried:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"no chunks; tried {', '.join(tried)}")


def upwards(spark: SparkSession, start: str, names: tuple[str, ...], variable: str | None = None) -> str | None:
    """What an environment variable names, if that is there; else the first of some names in the folder `start` or the nearest one above."""
    named = os.environ.get(variable, "") if variable else ""
    if named and exists(spark, named):
        return named
    _, place = _store(spark, start)
    while place is not None:
        for n in names:
            if exists(spark, f"{place.toString().rstrip('/')}/{n}"):
                return f"{place.toString().rstrip('/')}/{n}"
        place = place.getParent()
    return None


def site_root(spark: SparkSession, root: str, known: str | None = None) -> str:
    """The folder that holds a site's pages: root if there are any below it, else its folder of a known name, else the first of its folders by name that has some; root if none has.

    As pages are looked for at any depth, a folder in root is chosen only where
    root's own way to it is closed, by a name that is left out.
    """
    from .tables import html_files

    def has_pages(folder: str) -> bool:
        return not html_files(spark, folder).isEmpty()

    named = [f"{root.rstrip('/')}/{known}"] if known and is_folder(spark, f"{root.rstrip('/')}/{known}") else []
    return next((f for f in [root, *named, *folders(spark, root)] if has_pages(f)), root)
