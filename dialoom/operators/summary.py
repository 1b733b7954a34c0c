"""The summary of runs: counts, rates and means over the outputs of each run, beside what its report says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of a summary's measures and the metadata fields that they come from.
#: Outputs for which a field is true.
FLAGGED = {
    "review_required": "needs_review", "tension_mode_outputs": "tension_mode_active", "fallback_reframe_outputs": "active_speaker_fallback_used", "stitched_outputs": "stitched_story_unit",
    "dialogue_center_outputs": "reframe_dialogue_center_used", "listener_fallback_outputs": "reframe_listener_face_fallback_used", "subject_person_outputs": "subject_person_fallback_used",
    "subtitle_correction_outputs": "subtitle_correction_used", "auto_quality_retry_outputs": "auto_quality_retry_used", "auto_reframe_retry_outputs": "auto_reframe_retry_used",
    "remote_retry_candidates": "remote_quality_should_retry", "scene_interest_outputs": "reframe_scene_interest_fallback_used", "center_safe_fallback_outputs": "center_safe_fallback_used",
    "face_preserving_fallback_outputs": "face_preserving_fallback_used", "square_reframe_mode_outputs": "square_reframe_mode_used", "end_boundary_completion_ok_outputs": "end_boundary_completion_ok",
    "subtitle_remap_outputs": "subtitle_remap_used", "compaction_integrity_failed_outputs": "compaction_integrity_failed",
}
#: Outputs for which a field is above zero.
ABOVE_ZERO = {
    "incomplete_phrase_end_outputs": "incomplete_phrase_end_count", "subtitle_jitter_suspects": "subtitle_anchor_jitter_px", "subtitle_overlap_outputs": "subtitle_event_overlap_count", "subtitle_blink_outputs": "subtitle_gap_blink_count",
    "subtitle_visual_drop_outputs": "subtitle_visual_drop_count", "subtitle_blackout_outputs": "subtitle_blackout_count", "subtitle_persist_outputs": "subtitle_persisted_gaps_count",
    "speaker_to_listener_switch_outputs": "reframe_speaker_to_listener_switches", "weak_cold_open_outputs": "cold_open_dead_time_penalty",
}
#: Means over the outputs that have a field, to four digits.
AVERAGED = {
    "interestingness_avg": "interestingness_score", "avg_hook_strength": "hook_strength", "avg_visual_premise_strength": "visual_premise_strength", "avg_visible_stakes_score": "visible_stakes_score",
    "avg_first_frame_clarity_score": "first_frame_clarity_score", "avg_sound_off_hook_score": "sound_off_hook_score", "avg_sound_off_premise_score": "sound_off_premise_score", "avg_first_second_hook_score": "first_second_hook_score",
    "avg_premise_signal_score": "premise_signal_score", "avg_dialogue_dependency_penalty": "dialogue_dependency_penalty", "avg_watchability_score": "watchability_score", "avg_recommendation_readiness": "recommendation_readiness_score",
    "avg_packaging_quality": "packaging_quality_score", "avg_subtitle_confidence": "subtitle_confidence", "avg_subtitle_text_sanity": "subtitle_text_sanity_score", "avg_subtitle_language_consistency": "subtitle_language_consistency",
    "avg_subtitle_quality_score": "subtitle_quality_score",
}
#: Sums over all outputs.
SUMMED = {"speaker_transition_direct_total": "speaker_transition_direct_windows", "speaker_switch_latency_total": "speaker_switch_latency_windows", "handoff_glide_total": "handoff_glide_windows", "accent_frame_hold_total": "accent_frame_hold_windows"}
#: Values that are counted one by one.
COUNTED = {"duration_policy_bands": "duration_policy_band", "story_mode_counts": "story_mode", "subject_acquisition_state_counts": "subject_acquisition_state", "subject_acquisition_outcome_counts": "subject_acquisition_outcome"}
#: Whole numbers of a report's stats, 0 where they are missing.
STATS = {
    "windows": "total_windows", "story_candidates": "total_story_candidates", "publishable_candidates": "publishable_candidates", "episode_output_budget": "episode_output_budget", "episode_arc_count": "episode_arc_count",
    "selection_admission_target": "selection_admission_target", "selection_admission_cap": "selection_admission_cap", "selection_admission_pool": "selection_admission_pool", "story_override_candidates": "story_override_candidates",
} | {n: n for n in (
    "ranking_timeouts", "ranking_fallback_used", "ranking_fast_fallback_used", "ranking_failed", "semantic_preview_timeouts", "semantic_preview_fallback_used", "slow_stage_events", "hard_timeouts", "deferred_candidates",
    "skipped_due_to_timeout", "watchdog_fallback_used", "final_visual_rejects", "silent_parts_removed_total", "pause_policy_failed_outputs",
)}
FRACTIONS = ("episode_quality_floor", "episode_tension_density", "selection_admission_fraction")
#: Phrases of warnings and the rejection reason that the first one found among them stands for.
WARNED = (("no valid story candidates", "no_story_candidates"), ("no subtitles", "no_subtitles"), ("low subtitle turns", "low_subtitle_turns"), ("subtitle_confidence_low", "subtitle_confidence_low"), ("export_failed", "export_failed"))


def output_summary(outputs: DataFrame, by: str, misread: Column | None = None) -> DataFrame:
    """One row per run: what its outputs' metadata say. Fields that outputs have no column for count as missing.

    misread: whether generated_title is mis-encoded; repair.looks_misread() by default."""
    from ..functions.text import looks_misread

    kinds = dict(outputs.dtypes)
    of = lambda name, kind: F.col(name).cast(kind) if name in kinds else F.lit(None).cast(kind)
    true = lambda name: F.coalesce(of(name, "boolean"), F.lit(False))
    number = lambda name, default=0.0: F.coalesce(F.nullif(of(name, "double"), F.lit(0.0)) if default else of(name, "double"), F.lit(default))
    title = F.coalesce(of("generated_title", "string"), F.lit(""))
    misread = looks_misread(title) if misread is None else misread
    premise = F.greatest(*(number(n) for n in ("visual_premise_strength", "sound_off_hook_score", "first_second_hook_score", "premise_signal_score")))
    visible = F.coalesce(of("subject_visibility_ratio", "double"), F.lit(1.0))
    unseen = (visible < number("subject_visibility_threshold", 0.46)) | (number("no_subject_windows") > 0)
    tests = {
        "titled_outputs": title != "", "title_mojibake_outputs": (title != "") & misread, "subtitle_quality_retry_outputs": true("subtitle_quality_retry_used") | true("auto_quality_retry_used"),
        "subtitle_missing_outputs": F.coalesce(of("subtitle_status", "string").isin("missing", "generated"), F.lit(False)) & (number("subtitle_confidence") == 0),
        "weak_premise_outputs": premise < number("visual_premise_threshold", 0.48), "weak_subject_outputs": unseen, "weak_packaging_outputs": F.coalesce(of("packaging_quality_score", "double"), F.lit(1.0)) < 0.52,
    }
    tests |= {n: true(c) for n, c in FLAGGED.items()} | {n: number(c) > 0 for n, c in ABOVE_ZERO.items()}
    counts = [F.count_if(test).alias(n) for n, test in tests.items()]
    mean = lambda c, digits: F.round(F.sum(of(c, "decimal(18,6)")).cast("double") / F.nullif(F.count(of(c, "double")), F.lit(0)), digits)  # noqa: E731  the same in any order
    means = [mean(c, 4).alias(n) for n, c in AVERAGED.items()] + [mean("final_duration", 2).alias("avg_final_duration"), F.coalesce(mean("reframe_anchor_switches", 2), F.lit(0.0)).alias("avg_anchor_switches")]
    sums = [F.coalesce(F.sum(F.floor(of(c, "double"))), F.lit(0)).alias(n) for n, c in SUMMED.items()]
    share = lambda n: F.round(F.col(n) / F.nullif("outputs", F.lit(0)), 4)
    out = outputs.groupBy(by).agg(F.count("*").alias("outputs"), *counts, *means, *sums)
    return out.withColumns(
        {
            "avg_subtitle_blackout": share("subtitle_blackout_outputs"), "speaker_to_listener_switch_rate": share("speaker_to_listener_switch_outputs"), "subtitle_remap_usage_rate": share("subtitle_remap_outputs"),
            "compaction_integrity_failed_total": F.col("compaction_integrity_failed_outputs"),
        }
    )


def value_counts(outputs: DataFrame, by: str) -> DataFrame:
    """(by, counter, value, n) of COUNTED; an outcome that is missing is the state."""
    kinds = outputs.columns
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in kinds else F.lit("")
    value = lambda c: F.coalesce(F.nullif(of(c), F.lit("")), of("subject_acquisition_state")) if c == "subject_acquisition_outcome" else of(c)
    tall = outputs.select(by, F.explode(F.create_map(*(x for n, c in COUNTED.items() for x in (F.lit(n), value(c))))).alias("counter", "value"))
    return tall.where("value <> ''").groupBy(by, "counter", "value").agg(F.count("*").alias("n"))


def rejection_reason(stats_reason: Column, warnings: Column) -> Column:
    """The stats' own reason, or the one that the warnings name, or null."""
    joined = F.lower(F.array_join(warnings, " | "))
    return F.coalesce(F.nullif(stats_reason, F.lit("")), *(F.when(F.contains(joined, F.lit(text)), name) for text, name in WARNED))


def run_summary(reports: DataFrame, outputs: DataFrame, by: str) -> DataFrame:
    """One row per report(by, status, story_mode, requested_max, warnings, stats, stage_timings), also without outputs,
    in which counts are 0 and means null. stats: map of text; stage_timings: map of seconds."""
    stat = lambda name, kind: F.try_element_at("stats", F.lit(name)).try_cast(kind)
    pool = F.coalesce(stat("publishable_pool_before_final_visual_gate", "double"), stat("publishable_candidates", "double"), F.lit(0.0))
    told = reports.select(
        by, F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("story_mode", F.lit("")).alias("story_mode"), F.coalesce(stat("episode_story_mode", "string"), "story_mode", F.lit("")).alias("episode_story_mode"),
        "requested_max", F.size(F.coalesce("warnings", F.array())).alias("warnings_count"), rejection_reason(stat("main_rejection_reason", "string"), F.col("warnings")).alias("main_rejection_reason"),
        *(F.coalesce(F.floor(stat(c, "double")), F.lit(0)).cast("long").alias(n) for n, c in STATS.items()), F.floor(pool).cast("long").alias("publishable_pool_before_final_visual_gate"),
        *(F.coalesce(stat(c, "double"), F.lit(0.0)).alias(c) for c in FRACTIONS), F.try_element_at("stage_timings", F.lit("selection_total_seconds")).alias("selection_seconds"),
        F.try_element_at("stage_timings", F.lit("median_stage_seconds")).alias("median_stage_seconds"), "warnings",
    )
    made = output_summary(outputs, by)
    joined = told.join(made.drop("pause_policy_failed_outputs"), by, "left")
    counts = [c for c, kind in made.dtypes if kind == "bigint" and c != by]
    return reduce(lambda df, c: df.withColumn(c, F.coalesce(c, F.lit(0))), [*counts, "avg_anchor_switches"], joined)
