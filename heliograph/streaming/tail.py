"""Log forwarding, live tails, backfills and processed-set watermarks on Structured Streaming."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from heliograph.operators.relational import numbered


def read_log(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, at most ``files`` a batch; times without a zone are UTC."""
    reader = spark.readStream.schema(schema)
    df = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def forward(log: DataFrame, sink: str, checkpoint: str, ident: str, at: str, late: str = "1 day"):
    """Append new rows to a folder once each: offsets are in the checkpoint, repeats within ``late`` are dropped by id.

    Unlike a cursor on time, rows that share the boundary's time are not lost.
    """
    fresh = log.withWatermark(at, late).dropDuplicatesWithinWatermark([ident])
    return fresh.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(log: DataFrame, checkpoint: str, show: Callable[[DataFrame, int], None], name: str | None = None):
    """Hand every micro-batch to show."""
    writer = log.writeStream.foreachBatch(show).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


class LagNotice(StreamingQueryListener):
    """Tells a live tail how far it is behind: after every batch, what is there less what the query has seen.

    ``available`` gives the number of rows in the source; it is asked once a batch (for Parquet files it is in their footers).
    ``notice`` gets (batch id, rows behind) if more than ``most`` rows wait. Nothing is dropped: the rows come with
    later batches. ``seen`` is what earlier runs from the same checkpoint have read.
    """

    def __init__(self, name: str, available: Callable[[], int], notice: Callable[[int, int], None], most: int = 0, seen: int = 0):
        self.name, self.available, self.notice, self.most, self.seen = name, available, notice, most, seen

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name == self.name:
            self.seen += progress.numInputRows
            behind = self.available() - self.seen
            if progress.numInputRows and behind > self.most:
                self.notice(progress.batchId, behind)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def hourly_activity(log: DataFrame, at: str, kind: str, late: str = "1 hour") -> DataFrame:
    """Rows by kind and hour, closed when the watermark passes."""
    return log.withWatermark(at, late).groupBy(F.window(at, "1 hour"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), kind, "n")


def backfill(pending: DataFrame, derive: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Derive missing values batch by batch, each row once: a batch's output is the folder of its number, so a batch that
    is replayed after a failure between writing and committing replaces what it wrote.

    Folders also bear the checkpoint's name, so that several backfills may share a sink; read it with ``derived``.
    """
    owner = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def step(batch: DataFrame, number: int) -> None:
        derive(batch).write.mode("overwrite").parquet(f"{sink}/backfill={owner}/batch={number}")

    return pending.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def derived(spark: SparkSession, sink: str) -> DataFrame:
    """What backfills have written, with ``backfill`` and ``batch``; batches that found nothing have no files."""
    return spark.read.option("mergeSchema", "true").parquet(sink)


class Wake:
    """Runs a job when it is woken, and at least every so many seconds. However often it is woken meanwhile, one more run follows."""

    def __init__(self, job: Callable[[], None], every: float):
        self.job, self.every, self.runs = job, every, 0
        self._woken, self._ended = threading.Event(), threading.Event()

    def wake(self) -> None:
        self._woken.set()

    def stop(self) -> None:
        self._ended.set()
        self._woken.set()

    def run(self) -> None:
        """Runs until stopped; a run that has begun is finished."""
        while True:
            self._woken.wait(self.every)
            if self._ended.is_set():
                return
            self._woken.clear()
            self.job()
            self.runs += 1


def retry_state(attempts: DataFrame, key: str, failed, most: int = 3) -> DataFrame:
    """(key, failures, state): done after a success, dead after ``most`` failures, else pending."""
    counts = attempts.groupBy(key).agg(F.count_if(failed).alias("failures"), F.max(~failed).alias("succeeded"))
    return counts.select(key, "failures", F.when(F.col("succeeded"), "done").when(F.col("failures") >= most, "dead").otherwise("pending").alias("state"))


def upload_queue(entries: DataFrame, most: int = 5) -> DataFrame:
    """entries(id, status, priority, attempts) with the status after exhausted ones failed, and their place among the queued.

    What is not done after ``most`` attempts has failed. Queued entries go by priority, then by id; others have no place.
    """
    state = F.when((F.col("attempts") >= most) & (F.col("status") != "done"), "failed").otherwise(F.col("status"))
    judged = entries.withColumn("status", state)
    queued = numbered(judged.where("status = 'queued'"), ["priority", "id"], "place")
    return queued.unionByName(judged.where("status != 'queued' or status is null").withColumn("place", F.lit(None).cast("long")))


def unprocessed(items: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Items that no earlier run has recorded."""
    return items.join(processed.select(key).distinct(), key, "left_anti")
