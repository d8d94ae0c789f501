"""What a model made of texts, kept by content: each different text goes to a model once, and tables follow their texts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


class Memo:
    """A table (key, value) in a folder that all machines share, of one model; key is the SHA-256 of what the model gets.

    The model's record is written with it, and opening the table for another
    model fails. What is missing is computed in slices by key, each committed when
    it is done: a job that is killed leaves the finished slices, and the next one asks
    for the rest only. `pause` is the least time between two batches of a task, for
    models with a rate. Where a batch fails, its texts go one by one; one that fails alone
    gets `fallback` in this run and is asked again in the next. Without a fallback it fails the job.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, kind: str = "string", slices: int = 8, batch: int = 128, pause: float = 0.0):
        self.spark, self.path, self.model, self.kind, self.slices, self.batch, self.pause = spark, path.rstrip("/"), model, kind, slices, batch, pause
        try:
            known = spark.read.parquet(f"{self.path}/model").first()[0]
        except AnalysisException:  # a new table
            spark.createDataFrame([(model,)], "model string").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/model")
            known = model
        if known != model:
            raise ValueError(f"the table is of {known}, not of {model}")

    def kept(self) -> DataFrame:
        """(key, value), one row a key, whatever jobs wrote."""
        try:
            rows = self.spark.read.schema(f"key string, value {self.kind}").parquet(f"{self.path}/values")
        except AnalysisException:
            return self.spark.createDataFrame([], f"key string, value {self.kind}")
        return rows.groupBy("key").agg(F.min("value").alias("value"))

    def _asked(self, ask: Callable[[], Callable[[list[str]], list]], fallback):
        batch, pause = self.batch, self.pause

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, last = ask(), 0.0
            for frame in frames:
                for at in range(0, len(frame), batch):
                    part = frame.iloc[at : at + batch]
                    time.sleep(max(0.0, last + pause - time.monotonic()))
                    last = time.monotonic()
                    texts = part["text"].tolist()
                    try:
                        values, good = list(model(texts)), [True] * len(texts)
                    except Exception:
                        if fallback is None:
                            raise
                        values, good = [], []
                        for t in texts:
                            try:
                                values += list(model([t]))
                                good.append(True)
                            except Exception:  # this text alone gets the fallback
                                values.append(fallback)
                                good.append(False)
                    yield pd.DataFrame({"key": part["key"].tolist(), "value": values, "good": good})

        return run

    def filled(self, rows: DataFrame, text: Column, ask: Callable[[], Callable[[list[str]], list]], out: str, fallback=None) -> DataFrame:
        """rows with the model's value for each text in column `out`. `ask` is called once in a task and gives a function from texts to values.

        A text that many rows hold is asked once, and goes back to them by a join.
        Columns named _key or _value are not allowed.
        """
        keyed = rows.withColumn("_key", F.sha2(text, 256))
        distinct = keyed.select(F.col("_key").alias("key"), text.alias("text")).groupBy("key").agg(F.first("text").alias("text"))
        missing = distinct.join(self.kept().select("key"), "key", "left_anti")
        slice_of = F.pmod(F.xxhash64("key"), F.lit(self.slices))
        todo = {r[0] for r in missing.select(slice_of.alias("s")).distinct().collect()}  # numbers of slices
        failed = None
        for s in sorted(todo):
            answers = missing.where(slice_of == s).mapInPandas(self._asked(ask, fallback), f"key string, value {self.kind}, good boolean")
            if fallback is None:
                answers.select("key", "value").write.mode("append").parquet(f"{self.path}/values")
            else:
                place = f"{self.path}/runs/{time.time_ns()}"
                answers.write.parquet(place)
                done = self.spark.read.parquet(place)
                done.where("good").select("key", "value").write.mode("append").parquet(f"{self.path}/values")
                failed = done.where("not good") if failed is None else failed.unionByName(done.where("not good"))
        values = self.kept()
        if failed is not None:
            values = values.unionByName(failed.select("key", "value").join(values.select("key"), "key", "left_anti"))
        values = values.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
        return keyed.join(values, "_key", "left").select(*[F.col(c) for c in rows.columns if c != out], F.col("_value").alias(out))


def vectors(rows: DataFrame, text_col: str, memo: Memo, encoder: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "embedding") -> DataFrame:
    """rows with the unit vector of each text, empty ones as "[EMPTY]": only texts that the memo hasn't are encoded. memo's kind is array<float>."""

    def ask():
        encode = encoder()

        def unit(texts: list[str]) -> list[list[float]]:
            x = np.asarray(encode(texts), np.float64).reshape(len(texts), -1)
            return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32).tolist()

        return unit

    return memo.filled(rows, T.sanitized(F.col(text_col)), ask, out)


def replies(rows: DataFrame, prompt: Column, memo: Memo, model: Callable[[], Callable[[list[str]], list[str]]], out: str = "reply", fallback: str | None = None) -> DataFrame:
    """rows with a model's trimmed reply to each prompt: each different prompt is asked once, over all runs."""

    def ask():
        reply = model()
        return lambda texts: [(x or "").strip() for x in reply(texts)]

    return memo.filled(rows, T.text_of(prompt), ask, out, fallback)
