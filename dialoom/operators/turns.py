"""Dialogue turns and silence between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_tags, turn_type


def in_order():
    """A window over a source's rows in order."""
    return Window.partitionBy("source_id").orderBy("turn_id")


def dialogue_turns(segments: DataFrame, short_ms: int = 800, close_ms: int = 200) -> DataFrame:
    """Segments (source_id, seg_idx, start_ms, end_ms, text, speaker) as turns: clean text, type, and whether a turn
    interrupts, being shorter than short_ms and less than close_ms after the one before."""
    text = strip_tags(F.col("text"))
    turns = segments.select(
        "source_id", F.col("seg_idx").alias("turn_id"), "start_ms", F.greatest("start_ms", F.coalesce("end_ms", "start_ms")).alias("end_ms"), text.alias("text"),
        F.coalesce(F.nullif(F.trim("speaker"), F.lit("")), F.lit("UNKNOWN")).alias("speaker"),
    )
    turns = turns.withColumns({"duration_ms": F.col("end_ms") - F.col("start_ms"), "has_speech": F.col("text") != "", "turn_type": turn_type(F.col("text"))})
    gap = F.col("start_ms") - F.lag("end_ms").over(in_order())
    return turns.withColumn("is_interruption", F.coalesce((F.col("duration_ms") < short_ms) & (gap < close_ms), F.lit(False)))


def silence_spans(turns: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(source_id, start_ms, end_ms, duration_ms) between turns and, given totals(source_id, total_ms), after the last."""
    gaps = turns.select("source_id", F.lag("end_ms").over(in_order()).alias("start_ms"), F.col("start_ms").alias("end_ms"))
    if totals is not None:
        last = turns.groupBy("source_id").agg(F.max_by("end_ms", "turn_id").alias("start_ms")).join(totals, "source_id")
        gaps = gaps.unionByName(last.select("source_id", "start_ms", F.col("total_ms").alias("end_ms")))
    return gaps.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")).where("duration_ms > 0")


def speaker_timeline(segments: DataFrame, from_ms: int, to_ms: int, near_ms: int = 300) -> DataFrame:
    """(source_id, turn_no, start_ms, end_ms, speaker, text) of segments(source_id, seg_idx, start_ms, end_ms, text, speaker)
    within a range of time, cut to it; consecutive segments of one speaker less than near_ms apart are one turn.

    A segment without a speaker is an unknown one of its own, never the one before it. A missing end is half a second after
    the start, which is 0 where it is missing."""
    start = F.greatest(F.lit(from_ms), F.coalesce("start_ms", F.lit(0)))
    end = F.least(F.lit(to_ms), F.coalesce("end_ms", start + 500))
    who = F.coalesce(F.nullif(F.col("speaker"), F.lit("")), F.concat(F.lit("unknown_turn_"), F.col("seg_idx").cast("string")))
    inside = segments.select("source_id", "seg_idx", start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), who.alias("speaker"), F.coalesce("text", F.lit("")).alias("text")).where((F.col("end_ms") > F.col("start_ms")) & (F.col("start_ms") < to_ms))
    order = Window.partitionBy("source_id").orderBy("seg_idx")
    follows = (F.col("speaker") == F.lag("speaker").over(order)) & (F.col("start_ms") - F.lag("end_ms").over(order) < near_ms)
    marked = inside.withColumn("turn_no", F.sum((~F.coalesce(follows, F.lit(False))).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), " ")
    return marked.groupBy("source_id", "turn_no").agg(F.min_by("start_ms", "seg_idx").alias("start_ms"), F.max_by("end_ms", "seg_idx").alias("end_ms"), F.first("speaker").alias("speaker"), said.alias("text"))
