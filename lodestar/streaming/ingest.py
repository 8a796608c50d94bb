"""Continuous ingestion on Structured Streaming: arriving files, quiet periods, late results and publication."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestar.sources.snapshots import Store

QUIET_MS, MOST_WAIT_MS, RETRY_MS = 750, 2000, 30_000
#: Documents after which a first, a hundredth, a thousandth and every further block of results becomes visible.
FLUSH_AT, FLUSH_EVERY = (1, 100, 1000), 1024


def watch(spark: SparkSession, root: str, most_files: int = 1024) -> DataFrame:
    """Files below ``root`` as they arrive, in micro-batches of bounded size."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(root)


class Bursts(StatefulProcessor):
    """Change events of a root put together until it is quiet, but not for ever, and once more after a failure.

    A burst is due QUIET_MS after its last event, at most MOST_WAIT_MS after its first. A failed import is due again
    RETRY_MS later, unless a burst comes before. State is what is open; a timer stands at the moment it is due.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first bigint, last bigint, n bigint, retry bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        first, last, n, retry = self.open.get() or (None, None, 0, None)
        out = []
        for at, failed in sorted((int(at), bool(failed)) for part in rows for at, failed in zip(part["at"], part["failed"], strict=True)):
            while (due := self.due(first, last, n, retry)) is not None and due <= at:
                out.append((*key, due, first, n, "changes" if n else "retry"))
                first, last, n, retry = None, None, 0, None
            if failed:
                retry = at + RETRY_MS
            else:
                first, last, n = at if first is None else first, max(at, last or at), n + 1
        self.open.update((first, last, n, retry))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (due := self.due(first, last, n, retry)) is not None:
            self.handle.registerTimer(due)
        yield self.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        first, last, n, retry = self.open.get() or (None, None, 0, None)
        due = self.due(first, last, n, retry)
        self.open.clear()
        yield self.frame([] if due is None else [(*key, due, first, n, "changes" if n else "retry")])

    @staticmethod
    def due(first: int | None, last: int | None, n: int, retry: int | None) -> int | None:
        ends = [min(last + QUIET_MS, first + MOST_WAIT_MS)] if n else []
        return min(ends + ([retry] if retry is not None else []), default=None)

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["root", "due", "since", "n", "cause"]).astype({"due": "Int64", "since": "Int64", "n": "Int64"})

    def close(self) -> None:
        pass


def debounced(events: DataFrame, lateness: str = "30 seconds") -> DataFrame:
    """root, due, since, n, cause (changes or retry) of change events (root, ts, failed); times are in milliseconds.

    The session needs the RocksDB state store. What comes out depends on the events' own times alone, in whatever
    micro-batches they come, as long as none is later than ``lateness``.
    """
    timed = events.withWatermark("ts", lateness).select("root", "ts", F.unix_millis("ts").alias("at"), F.coalesce("failed", F.lit(False)).alias("failed"))
    return timed.groupBy("root").transformWithStateInPandas(Bursts(), "root string, due bigint, since bigint, n bigint, cause string", "Append", "EventTime")


def flush_points(progress: DataFrame) -> DataFrame:
    """Adds ``flush``: whether the numbered document (n, from 1) makes results visible."""
    return progress.withColumn("flush", F.col("n").isin(*FLUSH_AT) | (F.col("n") % FLUSH_EVERY == 0))


class Publication:
    """A sink that gathers rows and makes them visible, as generations of a store, when the count of rows says so.

    Each micro-batch is a folder of its own and a record of the count so far, so a batch that comes again after a failure
    does the same again. A batch that crosses a point of the rule publishes all that has been gathered since.
    """

    def __init__(self, store: Store, table: str):
        self.store, self.table = store, table

    def __call__(self, batch: DataFrame, number: int) -> None:
        folder = f"{self.store.root}/pending/{self.table}"
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        rows = self.store.spark.read.schema(batch.schema)
        before = self.record(number - 1)
        total = before["total"] + rows.parquet(f"{folder}/{number}").count()
        flush = any(before["total"] < at <= total for at in FLUSH_AT) or before["total"] // FLUSH_EVERY < total // FLUSH_EVERY
        head = self.store.head()
        if flush and (head or {}).get("generation") != f"batch-{number}":
            new = rows.parquet(*[f"{folder}/{i}" for i in range(before["next"], number + 1)])
            self.store.publish({self.table: self.store.current(self.table, head).unionByName(new) if head else new}, f"batch-{number}", (head or {}).get("generation"))
        self.store._create(self.recorded(number), {"total": total, "next": number + 1 if flush else before["next"]}, True)

    def recorded(self, number: int) -> str:
        return f"{self.store.root}/pending/{self.table}-{number}.json"

    def record(self, number: int) -> dict:
        return self.store._entry(self.recorded(number)) or {"total": 0, "next": 0}


def current_results(results: DataFrame, revisions: DataFrame) -> DataFrame:
    """results with state: completed if their revision still is the document's, else superseded."""
    now = revisions.select("doc_id", F.col("revision_id").alias("_now"))
    return results.join(now, "doc_id", "left").withColumn("state", F.when(F.col("_now") == F.col("revision_id"), "completed").otherwise("superseded")).drop("_now")


def run(stream: DataFrame, checkpoint: str, publish: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Processes all that is there and stops; ``publish`` gets each batch and its number, again after a failure."""
    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_continuously(stream: DataFrame, checkpoint: str, publish: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Processes what arrives, as soon as a quiet period allows."""
    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(processingTime=f"{QUIET_MS} milliseconds").start()
