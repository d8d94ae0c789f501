"""The edit log as kept state: any split of the log gives the same, also through a stream that fails and starts again."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.streaming.edit_log import EditLog, events_per_window, ingest

SCHEMA = "id string, ts double, topic string, gone boolean"


def log_of(r, n):
    """Edits of few keys with late records, equal times, removals and null keys."""
    return [(r.choice(("a", "b", "c", "d", None)), float(r.randrange(n // 2)), r.choice(("x", "y", None)), r.random() < 0.2) for _ in range(n)]


def plain(rows):
    last = {}
    for r in rows:
        rank = (r[1], (r[2] is not None, r[2] or ""), r[3])
        if r[0] is not None and (r[0] not in last or rank > last[r[0]][0]):
            last[r[0]] = (rank, r)
    return sorted(r for _, r in last.values() if not r[3])


def state(log, number=None):
    return sorted(tuple(r) for r in log.current(number).select("id", "ts", "topic", "gone").collect())


def test_any_split_gives_the_same(spark, tmp_path):
    r = random.Random(1)
    for k in range(3):
        rows = log_of(r, 24)
        shuffled = rows[:]
        r.shuffle(shuffled)
        log = EditLog(spark, f"file://{tmp_path}/{k}", SCHEMA, deleted="gone", every=3)
        cuts = sorted(r.randrange(25) for _ in range(4))
        for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 24])):
            log.add(spark.createDataFrame(shuffled[a:b], SCHEMA), n)
            assert state(log) == plain(shuffled[:b])


def test_backups_and_batches_that_come_again(spark, tmp_path):
    log = EditLog(spark, str(tmp_path / "s"), SCHEMA, deleted="gone", every=2, keep=2)
    batches = [[("a", 1.0, f"v{n}", False), (f"k{n}", 1.0 + n, "x", n == 3), ("a", 5.0 - n, "late", False)] for n in range(7)]
    for n, b in enumerate(batches):
        log.add(spark.createDataFrame(b, SCHEMA), n)
        log.add(spark.createDataFrame(b, SCHEMA), n)
        assert state(log) == plain(sum(batches[: n + 1], []))
    assert log._committed("snapshot") == [3, 5] and log._committed("delta") == [4, 5, 6]
    assert state(log, 4) == plain(sum(batches[:5], []))
    (tmp_path / "s" / "delta" / "7").mkdir()  # a writer that was lost
    assert state(log) == plain(sum(batches, []))
    log.add(spark.createDataFrame(batches[0], SCHEMA), 7)
    assert state(log) == plain(sum(batches, []))


def test_a_stream_goes_on_where_it_failed(spark, tmp_path):
    r, source = random.Random(5), tmp_path / "in"
    rows, failed = log_of(r, 60), []
    source.mkdir()

    class Failing(EditLog):
        def compact(self, number):
            if number == 1 and not failed:
                failed.append(number)
                raise RuntimeError("lost")
            super().compact(number)

    def feed(a, b):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").json(str(source))

    log = Failing(spark, str(tmp_path / "s"), SCHEMA, deleted="gone", every=2)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    feed(0, 15), feed(15, 30)
    with pytest.raises(Exception, match="lost"):
        log.follow(stream(), str(tmp_path / "c")).awaitTermination()
    log.follow(stream(), str(tmp_path / "c")).awaitTermination()
    assert failed and state(log) == plain(rows[:30])
    feed(30, 60)
    log.follow(stream(), str(tmp_path / "c")).awaitTermination()
    assert state(log) == plain(rows)


def test_windows_and_pages_as_streams(spark, tmp_path):
    events = [("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:10:00", "y")]
    os.makedirs(tmp_path / "e")
    spark.createDataFrame(events, "ts string, kind string").coalesce(1).write.mode("append").json(str(tmp_path / "e"))
    rows = spark.readStream.schema("ts timestamp, kind string").json(str(tmp_path / "e"))
    q = events_per_window(rows, "ts", "kind").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["kind"], r["count"]) for r in spark.table("windows").collect()) == [("x", 2), ("y", 1)]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.coalesce(1).write.parquet(str(tmp_path / "p"))
    got = []
    ingest(spark.readStream.schema(pages.schema).parquet(str(tmp_path / "p")), lambda blocks, n: got.append(blocks.select("page_id").distinct().count()), str(tmp_path / "pc")).awaitTermination()
    assert sum(got) == pages.select(F.col("page_id")).distinct().count()
