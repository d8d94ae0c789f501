"""An edit log as kept state: each batch's last edits as a delta, compacted into snapshots; and new pages as a stream (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.gold import last_edits


class EditLog:
    """The last edit of every key, by the columns of `order`, in a folder that all machines share.

    A batch leaves one delta, with the last record of each of its keys; every
    `every` batches the newest snapshot and the deltas behind it become a new
    snapshot, and of the older ones `keep` stay as backups. A folder counts once
    its writer has committed it, so a batch that failed half-way is simply
    written again: with the same number, it replaces itself. Late records, in
    whatever batch they come, lose against later ones by `order`.

    A record whose `deleted` column is true removes its key; it is kept, so that an
    edit from before it can't bring the key back. Null keys are left out; of
    records equal in `order` the greatest by the other columns counts, in any
    split of the log into batches.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", order: tuple[str, ...] = ("ts",), deleted: str | None = None, every: int = 8, keep: int = 2):
        self.spark, self.path, self.schema, self.key, self.order, self.deleted, self.every, self.keep = spark, path.rstrip("/"), schema, key, list(order), deleted, every, keep

    def _committed(self, kind: str) -> list[int]:
        """Numbers of the folders of a kind that are written to their end."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/*/_SUCCESS")
        found = pattern.getFileSystem(conf).globStatus(pattern)
        return sorted(int(f.getPath().getParent().getName()) for f in found or [])

    def _drop(self, kind: str, number: int) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{number}")
        path.getFileSystem(conf).delete(path, True)

    def _last(self, rows: DataFrame) -> DataFrame:
        return last_edits(rows.select(*[f.name for f in self._fields()]), self.key, self.order)

    def _fields(self):
        from pyspark.sql.types import StructType

        return StructType.fromDDL(self.schema).fields

    def _upto(self, number: int) -> DataFrame:
        """All keys' last records, removed ones among them, from batches up to a number."""
        snapshots = [n for n in self._committed("snapshot") if n <= number]
        base = snapshots[-1] if snapshots else -1
        folders = [f"{self.path}/snapshot/{base}"] * bool(snapshots) + [f"{self.path}/delta/{n}" for n in self._committed("delta") if base < n <= number]
        rows = self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)
        return self._last(rows)

    def add(self, batch: DataFrame, number: int) -> None:
        """One batch of the log; batches are numbered from 0 without gaps, as a stream does."""
        if any(n >= number for n in self._committed("snapshot")):
            return  # compacted already: the stream asks again for a batch whose end it didn't see
        self._last(batch).write.mode("overwrite").parquet(f"{self.path}/delta/{number}")
        if (number + 1) % self.every == 0:
            self.compact(number)

    def compact(self, number: int) -> None:
        """A snapshot of the batches up to a number; then what only older backups need goes."""
        self._upto(number).write.mode("overwrite").parquet(f"{self.path}/snapshot/{number}")
        snapshots = self._committed("snapshot")
        for n in snapshots[: -self.keep]:
            self._drop("snapshot", n)
        oldest = snapshots[-self.keep :][0]
        for n in self._committed("delta"):
            if n <= oldest:
                self._drop("delta", n)

    def current(self, number: int | None = None) -> DataFrame:
        """The keys that are not removed, with their last records; at an earlier batch as long as its backups are kept."""
        rows = self._upto((1 << 31) - 1 if number is None else number)
        return rows.where(~F.coalesce(F.col(self.deleted), F.lit(False))) if self.deleted else rows

    def follow(self, log: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """A stream of the log into this state; started again on the same checkpoint it goes on where it was."""
        return log.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def events_per_window(log: DataFrame, ts: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and kind, with a watermark for late records."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, window), kind).count()


def ingest(pages: DataFrame, write_blocks, checkpoint: str) -> StreamingQuery:
    """Parse new pages as they arrive; write_blocks gets each batch's blocks and its number."""
    from ..functions.html import blocks

    return pages.writeStream.foreachBatch(lambda batch, n: write_blocks(blocks(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
