"""The driver's tables as the tables that the operators take. Times are integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as timed segments (source_id, seg_idx, start_ms, end_ms, text, speaker)."""
    turns = table(spark, sf_dir, "conversations").withColumn("dur", 400 + 300 * word_count(F.col("text")))
    turns = turns.withColumn("gap", F.pmod(F.col("conv_id") * 37 + F.col("turn") * 91, F.lit(60)) * 100)
    order = Window.partitionBy("conv_id").orderBy("turn")
    end = F.sum(F.col("dur") + F.col("gap")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return turns.select(
        F.col("conv_id").alias("source_id"), (F.row_number().over(order) - 1).alias("seg_idx"), (end - F.col("dur")).alias("start_ms"), end.alias("end_ms"), "text", F.col("role").alias("speaker")
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as intervals (source_id, id, start_ms, end_ms, speaker, score): a minute per unit of value."""
    start = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("id"), start.alias("start_ms"), (start + F.round(F.col("value") * 60000).cast("long")).alias("end_ms"),
        F.col("event_type").alias("speaker"), F.col("value").alias("score"),
    )


def made_score(k: int) -> Column:
    """A made-up score in 0..1 with two digits, by integer arithmetic on doc_id."""
    return F.pmod(F.col("doc_id") * k, F.lit(101)) / F.lit(100.0)


#: Names of made-up metadata scores and the multipliers they are made with.
SCORES = {
    "hook_strength": 7, "hook_score": 11, "first_second_hook_score": 13, "premise_signal_score": 17, "subtitle_quality_score": 19, "pacing_score": 23, "speaker_centered_rate": 29,
    "subject_visibility_ratio": 31, "speaker_confidence_score": 37, "visual_conversation_score": 41, "retention_soft_score": 43, "visible_stakes_score": 47, "visual_subject_score": 53,
    "dialogue_dependency_penalty": 59, "story_completeness_score": 61, "payoff_strength": 67, "packaging_quality_score": 71, "title_quality_score": 73, "story_interest_score": 79,
    "story_context_score": 83, "story_coherence_score": 89, "story_completion_score": 97, "recommendation_readiness_score": 3, "watchability_score": 5, "first_frame_clarity_score": 9,
    "cold_open_dead_time_penalty": 15, "context_completeness_score": 21, "clarity_score": 27, "sound_off_hook_score": 33, "viral_soft_score": 39, "speaker_center_offset_avg": 45, "speaker_center_offset_p95": 49,
    "face_edge_clip_rate": 51, "duration_penalty": 55,
}
#: Names of made-up flags and counts: true, or one, where doc_id is divisible.
FLAGS = {
    "needs_review": 7, "ranking_fallback_used": 10, "ranking_fast_fallback_used": 20, "watchdog_fallback_used": 22, "semantic_preview_fallback_used": 26, "reframe_scene_interest_fallback_used": 12,
    "subject_person_fallback_used": 14, "face_preserving_fallback_used": 16, "rejected_for_missing_payoff": 17, "rejected_for_topic_jump": 19, "rejected_for_confusing_story": 23,
}
COUNTS = {"subtitle_overlap_outputs": 11, "subtitle_blink_outputs": 13, "speaker_switches": 3, "reframe_fallback_count": 9}
#: Scores that some rows lack: null where doc_id is divisible.
LACKING = {"retention_soft_score": 8, "story_coherence_score": 15, "story_completion_score": 21, "context_completeness_score": 6}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as candidate records: doc_id, made-up scores, duration, decision, review labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id")
    decision = F.element_at(F.array(*map(F.lit, ("accept", "review", "reject_visual", "reject_story"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    tags = F.array_compact(
        F.array(
            F.when(F.col("quality") == 1, "good").otherwise("bad"), F.when(F.pmod("doc_id", F.lit(3)) == 0, "publishable"), F.when(F.col("toxic") == 1, "confusing"), F.when(F.pmod("doc_id", F.lit(5)) == 0, "late_hook")
        )
    )
    given = lambda n, k: F.when(F.pmod("doc_id", F.lit(LACKING[n])) != 0, made_score(k)) if n in LACKING else made_score(k)
    story = F.struct(
        F.concat(F.lit("conv_"), F.pmod("doc_id", F.lit(50)).cast("string")).alias("conversation_id"), F.element_at(F.array(*map(F.lit, ("hook_only", "hook_setup"))), (F.pmod("doc_id", F.lit(2)) + 1).cast("int")).alias("story_arc_shape"),
        made_score(57).alias("story_coherence_score"), made_score(63).alias("story_completion_score"), F.lit(None).cast("double").alias("context_completeness_score"), F.lit("question").alias("hook_type"), F.lit("reveal").alias("payoff_type"),
    )
    return joined.select(
        "doc_id", "lang", "source", *(given(n, k).alias(n) for n, k in SCORES.items()), *((F.pmod("doc_id", F.lit(k)) == 0).alias(n) for n, k in FLAGS.items()), *(F.when(F.pmod("doc_id", F.lit(k)) == 0, 1).otherwise(0).alias(n) for n, k in COUNTS.items()),
        (F.pmod(F.col("n_chars"), F.lit(90))).alias("final_duration"), decision.alias("quality_governor_decision"), F.pmod("doc_id", F.lit(6)).alias("topic_shift_events"), tags.alias("human_labels"),
        F.when(F.pmod("doc_id", F.lit(9)) != 0, F.col("n_chars")).alias("runtime_ms"), (made_score(69) * 8).alias("trimmed_silence_seconds"), F.slice(F.array(*map(F.lit, (1, 2, 3))), F.lit(1), F.pmod("doc_id", F.lit(4)).cast("int")).alias("silence_trim_events"),
        F.when(F.pmod("doc_id", F.lit(5)) == 1, "unfinished").when(F.pmod("doc_id", F.lit(5)) == 2, "punchline").alias("payoff_type"), F.when(F.pmod("doc_id", F.lit(4)) == 1, "threat_tension").alias("hook_type"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("thread_"), F.pmod("doc_id", F.lit(20)).cast("string"))).alias("story_thread_id"), F.lit(None).cast("string").alias("conversation_id"),
        F.when(F.pmod("doc_id", F.lit(3)) == 1, "hook_setup_escalation").alias("story_arc_shape"), story.alias("story_summary"),
    )
