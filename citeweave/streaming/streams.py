"""Streaming forms: quotas, first-seen texts, and quotes checked as segments arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citeweave.functions.text import latin_words
from citeweave.operators.verify import SLACK, verify_words
from citeweave.plans.materialize import materialize
from citeweave.streaming.state import with_tails


def hourly_quota(requests: DataFrame, key: str, ts: str, most: int, late: str = "10 minutes") -> DataFrame:
    """Adds `allowed` to every request: true for the first `most` of a key in each clock hour, in order of arrival and then of time.

    The state is a count for each key and hour, dropped when the watermark has passed the hour.
    """
    df = requests.withWatermark(ts, late).withColumn("_hour", F.date_trunc("hour", ts))
    schema = T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType())])

    def counted(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        for rows in batches:
            rows = rows.sort_values(ts, kind="stable").drop(columns="_hour")
            rows["allowed"] = np.arange(n, n + len(rows)) < most
            n += len(rows)
            yield rows
        state.update((n,))
        end = int((pd.Timestamp(group[1]) + pd.Timedelta(hours=1)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    return df.groupBy(key, "_hour").applyInPandasWithState(counted, schema, "n long", "append", GroupStateTimeout.EventTimeTimeout)


def first_seen(texts: DataFrame, text: str, ts: str, ttl: str = "90 days") -> DataFrame:
    """The first of equal texts (by content hash) within the time that state is kept."""
    hashed = texts.withColumn("hash", F.sha2(F.trim(F.col(text)), 256))
    return hashed.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["hash"])


def check_segments(segments: DataFrame, passages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, ts: str | None = None, idle: str = "1 hour"):
    """Checks each micro-batch of (doc_id, text) segments against the passages (item_id, text) and hands the findings to `sink`.

    `passages` is static: words and grams are made once. With `ts`, a time column, and (doc_id, seg, text), the last words
    of a document are kept until the next segment comes, so that a quotation over the border of segments is found; the
    longest passage says how many. Candidates and alignment are those of the batch operator, over the kept and the new
    words; a finding that ends in the kept words alone was given before and is left out. `first_word` counts from the
    document's first word.
    """
    known = materialize(passages.select("item_id", latin_words(F.col("text")).alias("words")).where(F.size("words") > 0))
    if ts is None:
        def batch(df: DataFrame, number: int) -> None:
            if not df.isEmpty():
                sink(verify_words(known, df.select("doc_id", latin_words(F.col("text")).alias("words"))), number)

        return segments.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    longest = known.agg(F.coalesce(F.max(F.size("words")), F.lit(1))).first()[0]
    windows = with_tails(segments.select("doc_id", "seg", latin_words(F.col("text")).alias("words"), ts), "doc_id", "seg", "words", ts, longest + SLACK, idle)

    def joined(df: DataFrame, number: int) -> None:
        df = materialize(df.withColumn("_w", F.struct("doc_id", "start")))
        if df.isEmpty():
            return
        found = verify_words(known, df.select(F.col("_w").alias("doc_id"), "words")).join(df.select(F.col("_w").alias("doc_id"), "kept", F.size("words").alias("n")), "doc_id")
        fresh = found.where((F.col("first_word") < 0) | (F.col("last_word") >= F.col("kept")))
        sink(fresh.select("doc_id.doc_id", "item_id", "similarity", "coverage", "status", F.when(F.col("first_word") >= 0, F.col("first_word") + F.col("doc_id.start")).otherwise(F.col("first_word")).alias("first_word"), "difference"), number)

    return windows.writeStream.foreachBatch(joined).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
