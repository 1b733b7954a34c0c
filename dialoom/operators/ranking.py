"""Ranking, gating and selection of scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons

#: Weights of the assisted score, in the order in which they break ties.
ASSISTED = (
    ("recommendation_readiness_score", 0.34), ("watchability_score", 0.20), ("packaging_quality_score", 0.12), ("first_second_hook_score", 0.12),
    ("story_interest_score", 0.10), ("visible_stakes_score", 0.06), ("first_frame_clarity_score", 0.04), ("cold_open_dead_time_penalty", -0.08),
)


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def story_rank(candidates: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Adds rank within `by`: completion, payoff, coherence, clarity, hook and score, all descending, then `tie`."""
    order = [F.desc(zero("story_completion_score")), F.desc("has_payoff"), *(F.desc(zero(c)) for c in ("story_coherence_score", "clarity_score", "hook_score", "score")), tie]
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def publishable(candidates: DataFrame, by: list[str], tie: str, most: int = 5, least_s: float = 20.0) -> DataFrame:
    """The `most` best of each group that last 10 s, under 20 s only if complete to 0.75, and least_s at any rate."""
    long = F.col("duration") >= 10
    sound = (F.col("duration") >= 20) | (zero("story_completion_score") >= 0.75) | F.col("has_payoff")
    return story_rank(candidates.where(long & sound & (F.col("duration") >= least_s)), by, tie).where(F.col("rank") <= most)


def assisted_rank(records: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Adds score, the weighted sum of ASSISTED, and rank within `by`."""
    score = F.round(sum((zero(c) * w for c, w in ASSISTED), F.lit(0.0)), 4)
    order = [F.desc("score"), *(F.desc(zero(c)) for c, w in ASSISTED if w > 0), tie]
    return records.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_reason(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate that holds, or null."""
    return F.coalesce(*(F.when(test, name) for name, test in gates))


def selection_gates(pause: str = "final_duration") -> list[tuple[str, Column]]:
    """Parametrised reject gates in order; reports name the kind of gate, not the numbers."""
    return [
        ("too_short", F.col(pause) < 12), ("low_story_quality", zero("story_completion_score") < 0.25), ("insufficient_context", zero("story_context_score") < 0.2),
        ("weak_hook", zero("hook_score") < 0.15), ("subtitle_quality", zero("subtitle_quality_score") < 0.1), ("no_visible_subject", zero("subject_visibility_ratio") < 0.05),
    ]


def best_hook() -> Column:
    """The strongest of the five hook scores."""
    return F.greatest(*(zero(n) for n in ("hook_strength", "hook_score", "first_second_hook_score", "sound_off_hook_score", "premise_signal_score")))


def retention() -> Column:
    return F.coalesce("retention_soft_score", "viral_soft_score", F.lit(0.0))


def focus() -> Column:
    return F.greatest(zero("speaker_centered_rate"), zero("subject_visibility_ratio"))


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def failure_reasons() -> Column:
    """Root-cause tags of a metadata row, each once, in the order in which the rules find them. A missing score is 0,
    but a missing coherence is 1."""
    c, low, high = zero, lambda name, bound: zero(name) < bound, lambda name, bound: zero(name) > bound
    hook, kept, decision = best_hook(), retention(), F.lower(F.coalesce(F.col("quality_governor_decision"), F.lit("")))
    story = decision == "reject_story"
    rules = [
        ("late_hook", high("cold_open_dead_time_penalty", 0.18) | (hook < 0.50)),
        ("weak_hook", low("visible_stakes_score", 0.45) & (hook < 0.58)),
        ("wrong_face_focus", (focus() < 0.55) | low("visual_subject_score", 0.40)),
        ("speaker_unclear", low("subject_visibility_ratio", 0.48) & low("speaker_centered_rate", 0.50)),
        ("subtitle_overload", low("subtitle_quality_score", 0.55) | high("subtitle_overlap_outputs", 0) | high("subtitle_blink_outputs", 0)),
        ("missing_context", high("dialogue_dependency_penalty", 0.35)),
        ("weak_payoff", low("story_completeness_score", 0.48) & low("payoff_strength", 0.50)),
        ("bad_title", low("packaging_quality_score", 0.50) | low("title_quality_score", 0.55)),
        ("crop_jitter", high("speaker_center_offset_avg", 0.18) | high("speaker_center_offset_p95", 0.22)),
        ("bad_pacing", high("final_duration", 42) & (kept < 0.58)),
        ("confusing_dialogue", low("story_interest_score", 0.52) & low("story_context_score", 0.40)),
        ("confusing_dialogue", F.coalesce(F.col("story_coherence_score"), F.lit(1.0)) < 0.58),
        ("weak_payoff", low("story_completion_score", 0.56) | (F.lower(F.coalesce("payoff_type", F.lit(""))) == "unfinished")),
        ("confusing_dialogue", F.floor(c("topic_shift_events")) > 0),
        ("wrong_face_focus", low("visual_conversation_score", 0.48) | low("speaker_confidence_score", 0.42)),
        ("bad_pacing", low("pacing_score", 0.48) | (high("trimmed_silence_seconds", 4.0) & (kept < 0.62))),
        ("too_fast", low("final_duration", 35)),
        ("too_slow", high("final_duration", 60) & (kept < 0.50)),
        ("late_entry", flag("reframe_scene_interest_fallback_used") & low("subject_visibility_ratio", 0.30)),
        ("speaker_unclear", flag("subject_person_fallback_used") & low("visual_subject_score", 0.40)),
        ("crop_jitter", flag("face_preserving_fallback_used") & high("face_edge_clip_rate", 0.12)),
        ("wrong_face_focus", decision == "reject_visual"),
        ("late_hook", story & (hook < 0.50)),
        ("weak_payoff", story & low("story_completeness_score", 0.50)),
        ("missing_context", story & low("story_context_score", 0.40)),
        ("weak_payoff", flag("rejected_for_missing_payoff")),
        ("confusing_dialogue", flag("rejected_for_topic_jump")),
        ("confusing_dialogue", flag("rejected_for_confusing_story")),
    ]
    found = F.array_distinct(F.array_compact(F.array(*(F.when(test, tag) for tag, test in rules))))
    return F.array_intersect(found, F.array(*map(F.lit, lexicons.ROOT_CAUSES)))


def is_publishable() -> Column:
    """Accepted and not up for review, or good by three scores."""
    accepted = (F.lower("quality_governor_decision") == "accept") & ~flag("needs_review")
    good = (zero("recommendation_readiness_score") >= 0.64) & (zero("packaging_quality_score") >= 0.52) & (zero("subtitle_quality_score") >= 0.55)
    return F.coalesce(accepted, F.lit(False)) | good


#: Scores that a summary carries as they are, and those that the story's own summary gives where the row lacks them.
PLAIN = (
    "subtitle_quality_score", "pacing_score", "speaker_confidence_score", "visual_conversation_score", "watchability_score", "recommendation_readiness_score", "packaging_quality_score", "first_second_hook_score",
    "visible_stakes_score", "first_frame_clarity_score", "speaker_centered_rate", "subject_visibility_ratio", "trimmed_silence_seconds",
)
NESTED = ("story_coherence_score", "story_completion_score", "context_completeness_score")


def summary() -> Column:
    """The summary struct of a metadata row: scores rounded to four digits, story fields with nested fallbacks."""
    shown = lambda c: F.round(c, 4)
    named = lambda x: F.nullif(F.col(x), F.lit(""))
    conversation = F.col("story_summary.conversation_id")
    fields = {"hook_score": shown(best_hook()), "retention_soft_score": shown(retention()), "subtitle_quality": shown(zero("subtitle_quality_score")), "face_focus_rate": shown(focus()), "publishable": is_publishable()}
    fields |= {n: shown(zero(n)) for n in PLAIN} | {n: shown(F.coalesce(F.col(n), F.col(f"story_summary.{n}"), F.lit(0.0))) for n in NESTED}
    fields |= {"silence_trim_events_count": F.coalesce(F.size("silence_trim_events"), F.lit(0)), "story_thread_id": F.coalesce(named("story_thread_id"), conversation), "conversation_id": F.coalesce(named("conversation_id"), conversation)}
    fields |= {n: F.coalesce(named(n), F.col(f"story_summary.{n}")) for n in ("story_arc_shape", "hook_type", "payoff_type")}
    fields |= {"topic_shift_events": F.floor(zero("topic_shift_events")).cast("int"), "quality_governor_decision": F.col("quality_governor_decision")}
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def candidate_summary(records: DataFrame) -> DataFrame:
    """records with summary, and failure_reason where they don't name their reasons themselves."""
    found = failure_reasons()
    given = F.when(F.size("failure_reason") > 0, F.col("failure_reason")).otherwise(found) if "failure_reason" in records.columns else found
    return records.withColumns({"summary": summary(), "failure_reason": given})


def duration_policy(mode: str = "story_mode") -> Column:
    """Longest clip in seconds of a story mode."""
    return F.when(F.col(mode) == "short", 45).when(F.col(mode).isin("story", "dialogue"), 60).otherwise(35)


#: What starves a run, by reject reason.
STARVATION = {"insufficient_context": "boundary", "too_short": "boundary", "low_dialogue_flow": "vad", "low_story_quality": "quality", "weak_hook": "quality", "subtitle_quality": "quality", "no_visible_subject": "vision"}


def starvation_bucket(reason: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in STARVATION.items() for x in pair))
    return F.coalesce(F.element_at(known, reason), F.lit("other"))


def admission(turns: str = "turn_count", density: str = "speech_density", silence: str = "silence_ratio") -> Column:
    """Why a window isn't admitted, or null: no speech, too silent, or no dialogue; a parametrised rule."""
    return first_reason([("no_speech", F.col(turns) == 0), ("low_dialogue_flow", F.col(density) < 0.18), ("too_silent", F.col(silence) > 0.75), ("insufficient_context", F.col(turns) < 2)])


def admission_pool(candidates: DataFrame, by: str, share: float = 0.4, least: int = 2, most: int = 12) -> DataFrame:
    """Per group the number of accepted candidates and the size of the pool that goes on: a share, within bounds."""
    counts = candidates.where("quality_governor_decision = 'accept'").groupBy(by).agg(F.count("*").alias("n"))
    return counts.withColumn("pool", F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col("n") * share))).cast("long"))


def story_threads(candidates: DataFrame, by: str, at: str, coherence: str, least: float = 0.62, within: int = 24) -> DataFrame:
    """candidates with thread: neighbours at most `within` apart, the later one coherent to `least`, are one thread."""
    order = Window.partitionBy(by).orderBy(at)
    joins = (zero(coherence) >= least) & (F.col(at) - F.lag(at).over(order) <= within)
    return candidates.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("thread", F.sum("new").over(order)).drop("new")


def reranked(rows: DataFrame, by: list[str], score: str, preview: str, tie: str, most: int = 8) -> DataFrame:
    """rows with `rank` of each group: by `score`, but the `most` best among one another by `preview` where it is known.

    A preview that is missing (its time ran out) leaves a row with its score."""
    over = Window.partitionBy(*by)
    placed = rows.withColumn("place", F.row_number().over(over.orderBy(F.desc_nulls_last(score), tie)))
    top = F.col("place") <= most
    value = F.when(top, F.coalesce(preview, score)).otherwise(F.col(score))
    return placed.withColumn("rank", F.row_number().over(over.orderBy(F.desc(top), F.desc_nulls_last(value), tie))).drop("place")


def quality_governor() -> Column:
    """The decision on every candidate that got so far: accept, as the governor takes no exception."""
    return F.lit("accept")


#: How a warning names what became of a candidate.
WARNING = r"^Candidate (\d+) (?:rejected|downgraded): (\S+)"


def reject_paths(rejected: DataFrame, warnings: DataFrame) -> DataFrame:
    """(reason, n, sources): how often candidates fell out for a reason, by rejected(source_id, reason) and by the text of
    warnings(source_id, text); warnings of another form and missing reasons count for nothing."""
    told = warnings.select("source_id", F.regexp_extract("text", WARNING, 2).alias("reason"))
    every = rejected.select("source_id", "reason").union(told).where("reason <> ''")
    return every.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"))
