"""Structured Streaming forms of batch operators; an extension, the batch forms are the rule."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import topic_words
from ..operators.grouping import Bridge


def feedback_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New lines of the feedback log, with event time."""
    return spark.readStream.schema(schema).json(path).withColumn("at", F.to_timestamp("timestamp_utc"))


def live_blocks(turns: DataFrame, gap: str = "3500 milliseconds", late: str = "1 minute") -> DataFrame:
    """Gap sessions of turns(source_id, at, speaker): a block closes once the watermark has passed its gap."""
    window = F.session_window("at", gap)
    return turns.withWatermark("at", late).groupBy("source_id", window).agg(F.count("*").alias("turn_count"), F.array_sort(F.collect_set("speaker")).alias("speakers"))


def live_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and mean values of events(ts, event_type, value) per window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


BLOCK = "block long, speakers array<string>, words array<string>, size int, last long, turn long"
BRIDGED = "source_id long, turn_id long, block_no long, kind string"


class Bridging(StatefulProcessor):
    """The open block of each source as state; a timer closes it once no gap that long can be bridged."""

    def __init__(self, max_gap_ms: int):
        self.max_gap_ms = max_gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("block", BLOCK)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        block, speakers, words, size, last, turn = self.state.get() if self.state.exists() else (0, [], [], 0, None, None)
        bridge, out, ends = Bridge(self.max_gap_ms, block, speakers, words, size, last), [], None
        for r in pd.concat(list(rows)).sort_values("turn_id").itertuples(index=False):
            if turn is not None and r.turn_id <= turn:
                out.append((key[0], r.turn_id, None, "late"))
                continue
            out.append((key[0], r.turn_id, bridge.next(int(r.start_ms), int(r.end_ms), r.speaker, list(r.words)), "turn"))
            turn, ends = int(r.turn_id), r.at.value // 1_000_000 + int(r.end_ms - r.start_ms)  # in event time
        self.state.update((bridge.block, sorted(bridge.speakers), bridge.words, bridge.size, bridge.last, turn))
        if ends is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(ends + bridge.longest() + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["source_id", "turn_id", "block_no", "kind"]).astype({"block_no": "Int64"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        block, _, _, size, _, turn = self.state.get()
        if size:
            self.state.update((block + 1, [], [], 0, None, turn))
            yield pd.DataFrame([(key[0], turn, block, "closed")], columns=["source_id", "turn_id", "block_no", "kind"])


def live_bridged_blocks(turns: DataFrame, max_gap_ms: int = 3500, late: str = "1 minute") -> DataFrame:
    """turns(source_id, turn_id, start_ms, end_ms, speaker, text, at), at being event time, as (source_id, turn_id, block_no,
    kind): each turn with the block that bridged_blocks() gives it, as far as a source's turns come in order. A turn that
    comes after a later one is `late` and in no block. `closed` tells that the watermark has passed the end of a block by
    more than can be bridged; its speakers and words are forgotten then. Needs the RocksDB state store."""
    keyed = turns.withColumn("words", topic_words(F.col("text"))).select("source_id", "turn_id", "start_ms", "end_ms", "speaker", "words", "at")
    return keyed.withWatermark("at", late).groupBy("source_id").transformWithStateInPandas(Bridging(max_gap_ms), BRIDGED, "Append", "EventTime")
