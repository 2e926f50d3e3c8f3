"""Stateful processors: keys that expire by timers, results kept for a time to live, and the last words of a document.

They need the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`), which `use_rocksdb` sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ms(value) -> int:
    return int(pd.Timestamp(value).timestamp() * 1000)


class Expiry(StatefulProcessor):
    """Keeps when a key was last seen and a timer for when that is too long ago."""

    def __init__(self, key: str, ts: str, kept_ms: int):
        self.key, self.ts, self.kept_ms = key, ts, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = max(_ms(batch[self.ts].max()) for batch in rows)
        if self.last.exists():
            before = self.last.get()[0]
            self.handle.deleteTimer(before + self.kept_ms)
            seen = max(seen, before)
        self.last.update((seen,))
        self.handle.registerTimer(seen + self.kept_ms)
        yield pd.DataFrame({self.key: [key[0]], self.ts: [pd.Timestamp(seen, unit="ms")], "live": [True]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] + self.kept_ms <= expiredTimerInfo.getExpiryTimeInMs():
            seen = self.last.get()[0]
            self.last.clear()
            yield pd.DataFrame({self.key: [key[0]], self.ts: [pd.Timestamp(seen, unit="ms")], "live": [False]})

    def close(self) -> None:
        pass


def expiring(rows: DataFrame, key: str, ts: str, ttl: str, late: str = "10 minutes") -> DataFrame:
    """(key, ts, live): a row when a key is new or renewed, and one with `live` false when the watermark says that its time to live has passed since it was last seen.

    Timers fire without new rows of the key; rows behind the watermark are dropped; state goes with the key and survives
    a restart from the checkpoint.
    """
    schema = T.StructType([rows.schema[key], rows.schema[ts], T.StructField("live", T.BooleanType())])
    processor = Expiry(key, ts, int(pd.Timedelta(ttl).total_seconds() * 1000))
    return rows.select(key, ts).withWatermark(ts, late).groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")


class Kept(StatefulProcessor):
    """Keeps the first result of a key for a time to live of the state store."""

    def __init__(self, key: str, value: str, ttl_ms: int):
        self.key, self.value, self.ttl_ms = key, value, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("value", "value string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        values = [v for batch in rows for v in batch[self.value]]
        cached = self.state.exists()
        if not cached:
            self.state.update((values[0],))
        held = self.state.get()[0]
        yield pd.DataFrame({self.key: [key[0]] * len(values), self.value: [held] * len(values), "cached": [cached] + [True] * (len(values) - 1)})

    def close(self) -> None:
        pass


def cached_results(rows: DataFrame, key: str, value: str, ttl: str) -> DataFrame:
    """(key, value, cached): each row with the value that was first given for its key, which the state store keeps for `ttl` of processing time.

    Such state asks for batches without data all the time: a query that is to end needs
    `spark.sql.streaming.noDataMicroBatches.enabled` false.
    """
    schema = T.StructType([rows.schema[key], T.StructField(value, T.StringType()), T.StructField("cached", T.BooleanType())])
    processor = Kept(key, value, int(pd.Timedelta(ttl).total_seconds() * 1000))
    return rows.select(key, value).groupBy(key).transformWithStateInPandas(processor, schema, "append", "processingTime")


class Tails(StatefulProcessor):
    """Keeps a document's last words and how many there were before; segments that come too early wait until those before are there."""

    def __init__(self, key: str, ts: str, keep: int, idle_ms: int):
        self.key, self.ts, self.keep, self.idle_ms = key, ts, keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getValueState("tail", "start long, words array<string>, next long, timer long")
        self.early = handle.getMapState("early", "seg long", "words array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = timerValues.getCurrentWatermarkInMs()
        start, words, following, timer = self.tail.get() if self.tail.exists() else (0, [], 0, None)
        for batch in rows:
            newest = max(newest, _ms(batch[self.ts].max()))
            for seg, own in zip(batch["seg"], batch["words"]):
                if int(seg) >= following:
                    self.early.updateValue((int(seg),), (list(own),))
        fresh = []
        while self.early.containsKey((following,)):
            fresh += list(self.early.getValue((following,))[0])
            self.early.removeKey((following,))
            following += 1
        if timer:
            self.handle.deleteTimer(timer)
        timer = newest + self.idle_ms
        self.handle.registerTimer(timer)
        window = [*words, *fresh]
        cut = max(0, len(window) - self.keep)
        self.tail.update((start + cut, window[cut:], following, timer))
        if fresh:
            yield pd.DataFrame({self.key: [key[0]], "start": [start], "kept": [len(words)], "words": [window]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A document that has gone quiet gives what waits, in order, and is forgotten."""
        if not self.tail.exists() or self.tail.get()[3] != expiredTimerInfo.getExpiryTimeInMs():
            return
        start, words, _, _ = self.tail.get()
        fresh = [w for _, own in sorted((k[0], list(v[0])) for k, v in self.early.iterator()) for w in own]
        self.early.clear()
        self.tail.clear()
        if fresh:
            yield pd.DataFrame({self.key: [key[0]], "start": [start], "kept": [len(words)], "words": [[*words, *fresh]]})

    def close(self) -> None:
        pass


def with_tails(segments: DataFrame, key: str, seg: str, words: str, ts: str, keep: int, idle: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, kept, words): the new words of a document behind the last `keep` ones before them, of which there are `kept`; `start` is the place of the first.

    Segments are numbered from 0 and put in order; a repeated number counts once. A document that has been quiet for `idle`
    is forgotten.
    """
    schema = T.StructType([segments.schema[key], T.StructField("start", T.LongType()), T.StructField("kept", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))])
    rows = segments.select(segments[key], segments[seg].alias("seg"), segments[words].alias("words"), segments[ts]).withWatermark(ts, late)
    return rows.groupBy(key).transformWithStateInPandas(Tails(key, ts, keep, int(pd.Timedelta(idle).total_seconds() * 1000)), schema, "append", "eventTime")
