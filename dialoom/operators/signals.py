"""Story signals of timed text, windows over it, and how alike neighbours are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import language_consistency, squeeze, strings, text_sanity, tokens

# English word sets of the signals.
CONNECTORS = ("and", "but", "or", "because", "if", "when", "then", "that")
EMOTIONS = ("why", "stop", "no", "look", "listen", "truth", "killed", "never", "wait")
QUESTIONS = ("who", "what", "why", "where", "when", "how")
PAYOFFS = ("so", "therefore", "now", "look", "see", "understand", "fine", "okay")


def one(c: Column) -> Column:
    return F.least(F.lit(1.0), c)


def story_signals(segments: DataFrame, lang: str = "en", confidence: float = 0.8) -> DataFrame:
    """Per source of segments(source_id, seg_idx, start_ms, end_ms, text): exchange, hook, development, closure,
    emotion, interest and quality, each in 0..1, and whether it starts in the middle or ends a line."""
    packed = F.array_sort(F.collect_list(F.struct("seg_idx", "start_ms", "end_ms", "text")))
    x = segments.groupBy("source_id").agg(packed.alias("s"))
    x = x.withColumns({"n": F.size("s"), "full": squeeze(F.array_join("s.text", " ")), "first": F.get("s", F.lit(0)), "last_text": F.trim(F.element_at("s", -1)["text"])})
    x = x.withColumns({"words": tokens(F.col("full")), "first_text": F.trim(F.col("first.text")), "at": F.col("first.start_ms")})
    holds = lambda c, words: F.exists(strings(words), lambda w: F.contains(F.lower(c), w))
    ends = F.col("last_text").rlike(r"[.!?]$")
    marks = F.length(F.regexp_replace("full", r"[^?]", ""))
    bonus = F.when((marks > 0) & (F.col("n") >= 2) & ~F.col("last_text").endswith("?"), one(marks * 0.35)).otherwise(0.0)
    exchange = one(F.col("n") / 4.0)
    emotion = one(F.size(F.filter("words", lambda w: w.isin(*EMOTIONS))) / 3.0)
    hook = 0.30 + F.when(F.col("at") <= 350, 0.22).otherwise(0.0) + F.when(holds(F.col("first_text"), ("?", *QUESTIONS)), 0.18).otherwise(0.0)
    hook = hook + F.when(holds(F.col("first_text"), EMOTIONS), 0.18).otherwise(0.0) + F.when(F.length("first_text") <= 48, 0.12).otherwise(0.0)
    x = x.withColumns({"exchange": exchange, "bonus": bonus, "emotion": emotion, "hook": F.when(F.col("first_text") == "", 0.0).otherwise(one(hook))})
    x = x.withColumns(
        {
            "development": one(F.col("exchange") * 0.48 + one(F.size("words") / 22.0) * 0.24 + one(F.col("n") / 3.0) * 0.28),
            "closure": one(F.when(ends, 0.55).otherwise(0.18) + F.col("bonus") * 0.25 + F.when(holds(F.col("full"), PAYOFFS), 0.20).otherwise(0.0)),
        }
    )
    interest = one(F.col("exchange") * 0.18 + F.col("bonus") * 0.16 + F.col("emotion") * 0.14 + F.col("hook") * 0.20 + F.col("development") * 0.14 + F.col("closure") * 0.18)
    quality = one(confidence * 0.34 + text_sanity(F.col("full"), F.lit(lang)) * 0.38 + language_consistency(F.col("full"), F.lit(lang)) * 0.18 + one(F.col("n") / 4.0) * 0.10)
    mid = F.coalesce(F.get("words", F.lit(0)).isin(*CONNECTORS), F.lit(False)) | (F.col("at") > 550)
    return x.select(
        "source_id", F.round("exchange", 4).alias("dialogue_exchange_score"), F.round("bonus", 4).alias("question_answer_bonus"), F.round("emotion", 4).alias("emotion_signal"), F.round("hook", 4).alias("hook_score"),
        F.round("development", 4).alias("development_score"), F.round("closure", 4).alias("closure_score"), F.round(interest, 4).alias("interestingness_score"), F.round(quality, 4).alias("subtitle_quality_score"),
        mid.alias("starts_mid_phrase"), ends.alias("line_like_closure"), F.length("full").alias("text_length"),
    )


def window_summary(turns: DataFrame, windows: DataFrame) -> DataFrame:
    """windows(source_id, start_ms, end_ms) with turns that begin in them, speech time, density and silence ratio.

    Turns and windows meet in slots of the longest window, so the join is on equal keys."""
    width = 60_000
    slots = windows.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor((F.col("end_ms") - 1) / width))))
    placed = turns.select("source_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.floor(F.col("start_ms") / width).alias("slot"))
    met = slots.join(placed, ["source_id", "slot"]).where("s >= start_ms and s < end_ms")
    sums = met.groupBy("source_id", "start_ms", "end_ms").agg(F.count("*").alias("turn_count"), F.sum(F.least("e", "end_ms") - F.col("s")).alias("speech_ms"))
    out = windows.join(sums, ["source_id", "start_ms", "end_ms"], "left").fillna(0, ["turn_count", "speech_ms"])
    density = F.round(one(F.col("speech_ms") / (F.col("end_ms") - F.col("start_ms"))), 4)
    return out.withColumn("speech_density", density).withColumn("silence_ratio", F.round(1.0 - F.col("speech_density"), 4))


def scene_windows(scenes: DataFrame, least_ms: int = 35_000, most_ms: int = 60_000, overlap_ms: int = 15_000) -> DataFrame:
    """scenes(source_id, start_ms, end_ms) of least_ms or more as windows of at most most_ms, overlapping where cut."""
    long = scenes.where(F.col("end_ms") - F.col("start_ms") >= least_ms)
    last = F.greatest("start_ms", F.col("end_ms") - overlap_ms - 1)
    starts = long.withColumn("at", F.explode(F.sequence(F.col("start_ms"), last, F.lit(most_ms - overlap_ms).cast("long"))))
    return starts.select("source_id", F.col("at").alias("start_ms"), F.least("end_ms", F.col("at") + most_ms).alias("end_ms")).where("end_ms > start_ms")


def neighbour_overlap(blocks: DataFrame, by: str, order_by: str) -> DataFrame:
    """How alike each block(speakers, topics) is to the one before: Jaccard of both, and overlap by the larger set."""
    order = Window.partitionBy(by).orderBy(order_by)
    jaccard = lambda a, b: F.round(F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0)), 4)
    larger = lambda a, b: F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a), F.size(b)), 4)
    x = blocks.withColumns({"ps": F.lag("speakers").over(order), "pt": F.lag("topics").over(order)}).where("ps is not null")
    return x.select(by, order_by, jaccard(F.col("speakers"), F.col("ps")).alias("speaker_jaccard"), jaccard(F.col("topics"), F.col("pt")).alias("topic_jaccard"), larger(F.col("topics"), F.col("pt")).alias("topic_overlap"))


def pair_coherence(gap_ms: Column, same_source: Column, same_type: Column, topics: Column, within_ms: int = 24_000) -> Column:
    """Coherence in 0..1 of two candidates: nearness, source, type and topics; a parametrised rule."""
    near = F.greatest(F.lit(0.0), 1.0 - F.abs(gap_ms) / float(within_ms))
    return F.round(near * 0.4 + F.when(same_source, 0.2).otherwise(0.0) + F.when(same_type, 0.2).otherwise(0.0) + topics * 0.2, 4)


def subtitle_cuts_wanted(clips: DataFrame, segments: DataFrame, named: Column) -> DataFrame:
    """clips(source_id, face_failed) where cuts by speaker are to be used: a face failure and a named speaker."""
    speakers = segments.where(named).groupBy("source_id").agg(F.countDistinct("speaker").alias("named"))
    out = clips.groupBy("source_id").agg(F.bool_or("face_failed").alias("failed")).join(speakers, "source_id", "left").fillna(0, ["named"])
    return out.select("source_id", "named", (F.col("failed") & (F.col("named") >= 1)).alias("use_cuts"))
