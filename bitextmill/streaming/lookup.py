"""Streams of segments against a memory: exact hits as a stream-static join, repetitions within a watermark."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Milliseconds of event time that an entry is remembered behind the watermark.
KEPT = 3_600_000


def exact_hits(stream: DataFrame, memory: DataFrame) -> DataFrame:
    """Streaming segments (entry, ...) with the targets that the memory holds for them."""
    return stream.join(memory.select(F.col("source").alias("entry"), "target"), "entry", "left")


def word_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Words by file and window; rows later than ``late`` are dropped."""
    from ..functions.text import word_count

    counted = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "file")
    return counted.agg(F.sum(word_count(F.col("entry"))).alias("words"))


def fresh_entries(stream: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each entry once within the watermark: later ones are repetitions."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["entry"])


def leverage(stream: DataFrame, memory: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Segments of a stream (file, entry, ordinal, ``time``) with their words and band, as the batch report tells them: the
    first occurrence of an entry is a full match if the memory holds it, else new; later ones are repetitions.

    The state of an entry says that it occurred and goes when the watermark is KEPT past its last occurrence; rows of
    one batch count in the order of ``time`` and ordinal. Null entries have no band and are left out.
    """
    from ..functions.text import word_count
    from ..operators.analyze import FULL, NEW, REPETITIONS

    known = memory.select(F.col("source").alias("entry")).distinct().withColumn("known", F.lit(True))
    rows = stream.where(F.col("entry").isNotNull()).withWatermark(time, late).join(known, "entry", "left").select("file", "entry", "ordinal", F.col(time).alias("ts"), "known", word_count(F.col("entry")).cast("long").alias("words"))

    def bands(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        found = pd.concat(list(batches)).sort_values(["ts", "ordinal"])
        first = NEW if found["known"].isna().iloc[0] else FULL
        found["band"] = [REPETITIONS if i or state.exists else first for i in range(len(found))]
        state.update((True,))
        state.setTimeoutTimestamp(max(int(found["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + KEPT)
        yield found[["file", "entry", "ordinal", "words", "band"]]

    ordinal = stream.schema["ordinal"].dataType.simpleString()
    return rows.groupBy("entry").applyInPandasWithState(bands, f"file string, entry string, ordinal {ordinal}, words long, band string", "seen boolean", "append", "EventTimeTimeout")
