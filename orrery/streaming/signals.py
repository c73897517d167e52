"""Signals of keyed streams in Spark's state store: a key that shows one value again and again, in the order of event time.

State lives in RocksDB and is part of the stream's checkpoint, so a restart goes on where the last batch ended and a
batch writes only the keys that it touches. For each key it holds the observations that the watermark hasn't
passed yet, and one row: the value of the run so far, its length, its first time and the last time. Observations
are taken in order of time, then value, once the watermark has passed them, so the order of arrival doesn't matter within
`delay`. Later ones are dropped by Spark, which counts them. A key that has been idle for `idle` is forgotten.
State is thus bounded by the observations of `delay` and the keys of `idle`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, value string, since long, at long"


class RunSignals(StatefulProcessor):
    """A row for each run of at least `least` equal values of a key, when it reaches that length. Times are microseconds."""

    def __init__(self, least: int, idle_us: int):
        self.least, self.idle = least, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value for all that a key has, as each call of the store is a round trip to the executor
        self.state = handle.getValueState("state", "value string, n long, since long, at long, timer long, waiting array<struct<at: long, value: string>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [x for frame in rows for x in zip(frame["at"].tolist(), frame["value"].tolist(), strict=True)]
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), [], expiredTimerInfo.getExpiryTimeInMs())

    def _advance(self, key, watermark_ms: int, fresh: list, expired: int | None = None) -> Iterator[pd.DataFrame]:
        mark = watermark_ms * 1000
        value, n, since, last, timer, waiting = self.state.get() or (None, 0, 0, 0, None, [])
        waiting = sorted([*map(tuple, waiting), *fresh], key=lambda x: (x[0], x[1] is not None, x[1] or ""))
        due = [x for x in waiting if x[0] <= mark]
        left = waiting[len(due) :]
        out = []
        for at, v in due:
            if n == 0 or value != v or at - last > self.idle:
                value, n, since = v, 0, at
            n, last = n + 1, at
            if n == self.least:
                out.append((key[0], v, since, at))
        forgotten = not left and (n == 0 or last + self.idle <= mark)
        # wakes up when the watermark reaches the next observation, or when the key has been idle for long enough
        wake = None if forgotten else max(-(-(left[0][0] if left else last + self.idle) // 1000), watermark_ms + 1)
        if timer is not None and timer not in (wake, expired):  # Spark deletes the one that expired
            self.handle.deleteTimer(timer)
        if wake is not None and wake != timer:
            self.handle.registerTimer(wake)
        if forgotten:
            self.state.clear()
        else:
            self.state.update((value, n, since, last, wake, left))
        if out:
            yield pd.DataFrame(out, columns=["key", "value", "since", "at"])

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """RocksDB as the state store of queries that start within."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def signals(stream: DataFrame, *, key: str, value: str, at: str, delay: str, idle: timedelta, least: int = 3) -> DataFrame:
    """A streaming DataFrame of key, value, since and at (timestamps): runs that reach `least`, in append mode.

    at is a timestamp, one without a zone is of the session's. Null keys and times are no observation; a null value equals another. Equal rows count each.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), F.col(at).cast("timestamp").alias("time")).filter("key IS NOT NULL AND time IS NOT NULL")
    rows = rows.withWatermark("time", delay).withColumn("at", F.unix_micros("time"))
    found = rows.groupBy("key").transformWithStateInPandas(RunSignals(least, int(idle.total_seconds() * 1e6)), OUT, "Append", "EventTime")
    return found.select("key", "value", F.timestamp_micros("since").alias("since"), F.timestamp_micros("at").alias("at"))


def landed(found: DataFrame, *, table: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what its source has now and returns all that it has landed below `table` so far.

    Each batch writes a folder of its number, so one that runs again after a failure replaces what it had written.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={epoch}")

    spark = found.sparkSession
    with rocksdb(spark):
        query = found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(found.schema).option("recursiveFileLookup", "true").parquet(table)
