"""Classified pauses between voiced intervals, the keep or cut decision, and what it does to pacing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import merge_intervals, neighbours


@dataclass(frozen=True)
class PauseRules:
    """Thresholds of energy in 0..1 and lengths in milliseconds."""

    event_energy: float = 0.16
    soft_energy: float = 0.11
    keep_ms: int = 1_000
    story_ms: int = 1_150

    @property
    def story_energy(self) -> float:
        return max(self.event_energy, self.event_energy + 0.02)

    @property
    def story_limit_ms(self) -> int:
        return min(max(self.story_ms, self.keep_ms), self.keep_ms + 150)


def classify(rules: PauseRules) -> Column:
    """struct<type, confidence, trim, limit_ms, reason> of a row (duration_ms, energy, prev_ms, next_ms, bonus): the
    first rule that holds."""
    gap, energy, bonus = F.col("duration_ms"), F.col("energy"), F.col("bonus")
    shorter = F.least("prev_ms", "next_ms")
    quiet, audible = energy <= max(0.03, rules.soft_energy * 0.45), energy >= max(0.06, rules.soft_energy * 0.85)
    short, strong, uneven = shorter <= 650, shorter >= 850, F.abs(F.col("prev_ms") - F.col("next_ms")) >= 550
    kind = lambda t, c, trim, limit, why: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"), (trim if isinstance(trim, Column) else F.lit(trim)).alias("trim"), (limit if isinstance(limit, Column) else F.lit(limit)).alias("limit_ms"), F.lit(why).alias("reason"))
    rule = [
        ((gap >= 2000) & quiet & (bonus < 0.45), kind("dead_air", 0.92, True, 1500, "low_energy_long_gap")),
        ((gap <= 750) & (bonus >= 0.72) & (short | uneven), kind("reaction_pause", 0.68, False, 1500, "reaction_hold")),
        (gap <= 750, kind("unknown", 0.44, False, 1500, "short_gap")),
        ((gap <= 3000) & (bonus >= 0.84) & strong & audible, kind("emotional_pause", 0.74, False, 2500, "emotional_hold")),
        ((gap <= 3000) & (bonus >= 0.82) & short, kind("comedic_pause", 0.72, False, 3000, "comic_timing")),
        ((gap <= 2500) & (bonus >= 0.76) & strong, kind("tension_pause", 0.70, False, 2500, "tension_bridge")),
        ((gap <= 3000) & (bonus >= 0.62) & audible, kind("reaction_pause", 0.61, False, 1500, "reaction_flow")),
        ((gap > 2000) & quiet & (bonus < 0.58), kind("unknown", 0.48, True, 1500, "uncertain_low_energy")),
        ((energy >= rules.story_energy) & (bonus >= 0.55), kind("emotional_pause", 0.58, False, 2500, "energetic_hold")),
    ]
    rest_trim, rest_limit = (gap > 3000) & quiet & (bonus < 0.40), F.when(gap <= 2500, 1500).otherwise(3000)
    out = None
    for test, value in rule:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.when(quiet, kind("unknown", 0.52, rest_trim, rest_limit, "uncertain")).otherwise(kind("unknown", 0.57, rest_trim, rest_limit, "uncertain"))


def decide(rules: PauseRules) -> Column:
    """struct<decision, reason> of a classified row (p: its classification)."""
    gap, energy, bonus, p = F.col("duration_ms"), F.col("energy"), F.col("bonus"), F.col("p")
    soft = (energy >= rules.soft_energy) | (bonus >= 0.62)
    hold = soft | (energy >= rules.event_energy) | (bonus >= 0.50) | ~p["trim"]
    out = lambda d, why: F.struct(F.lit(d).alias("decision"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))
    held = F.when(p["type"] == "comedic_pause", "comedic_timing").when(p["type"] == "emotional_pause", "emotional_hold").when(p["type"] == "reaction_pause", "reaction_hold").when(p["type"] == "tension_pause", "tension_hold")
    held = held.when(energy >= rules.story_energy, "event_energy").when(bonus >= 0.92, "continuation_bonus").when(soft, "soft_context").otherwise("story_gap")
    return (
        F.when(gap <= rules.keep_ms, out("soft_keep", "short_gap"))
        .when((p["type"] == "dead_air") | ((p["type"] == "unknown") & (p["confidence"] < 0.50) & p["trim"]), out("cut", p["reason"]))
        .when((gap <= rules.story_limit_ms) & hold, out("keep_for_story", held))
        .when((p["type"] == "unknown") & (p["confidence"] >= 0.50) & ~p["trim"], out("keep_for_story", "uncertain_preserve"))
        .otherwise(out("cut", F.when(gap > max(rules.story_ms, rules.keep_ms), "long_silence").otherwise("over_2s_silence")))
    )


def pause_timeline(voiced: DataFrame, silences: DataFrame | None = None, energy: DataFrame | None = None, rules: PauseRules = PauseRules()) -> DataFrame:
    """Gaps of voiced(source_id, start_ms, end_ms), with silences merged in, as classified pauses.

    energy: (source_id, start_ms, end_ms, energy) of gaps; 0 where it has none."""
    order = Window.partitionBy("source_id").orderBy("start_ms", "end_ms")
    gaps = voiced.select("source_id", F.lag("end_ms").over(order).alias("start_ms"), F.col("start_ms").alias("end_ms")).where("end_ms > start_ms")
    if silences is not None:
        gaps = gaps.unionByName(silences.where(F.col("end_ms") - F.col("start_ms") >= max(450, rules.keep_ms * 0.8)).select("source_id", "start_ms", "end_ms"))
    merged = merge_intervals(gaps).drop("n")
    near = neighbours(merged, voiced)
    if energy is not None:
        near = near.join(energy, ["source_id", "start_ms", "end_ms"], "left")
    else:
        near = near.withColumn("energy", F.lit(None).cast("double"))
    near = near.withColumns({"energy": F.coalesce("energy", F.lit(0.0)), "duration_ms": F.col("end_ms") - F.col("start_ms"), "bonus": F.least(F.lit(1.0), F.least("prev_ms", "next_ms") / F.lit(1150.0))})
    near = near.withColumn("p", classify(rules)).withColumn("d", decide(rules))
    return near.select(
        "source_id", "start_ms", "end_ms", "duration_ms", F.round("energy", 4).alias("energy"), F.round("bonus", 4).alias("continuation_bonus"), F.col("p.type").alias("silence_type"),
        F.col("p.confidence").alias("silence_confidence"), F.col("p.limit_ms").alias("limit_ms"), F.col("p.trim").alias("trim_allowed"), F.col("d.decision").alias("decision"), F.col("d.reason").alias("reason"),
    )


def pause_stats(timeline: DataFrame) -> DataFrame:
    """Per source: pauses by decision, cut and kept time, pauses by type."""
    count = lambda test: F.count_if(test)
    cut, story = F.col("decision") == "cut", F.col("decision") == "keep_for_story"
    types = ("dead_air", "comedic_pause", "emotional_pause", "reaction_pause", "tension_pause", "unknown")
    return timeline.groupBy("source_id").agg(
        F.count("*").alias("pauses"), count(cut).alias("cut_count"), count(F.col("decision") == "soft_keep").alias("soft_keep_count"), count(story).alias("story_keep_count"),
        F.sum(F.when(cut, F.col("duration_ms")).otherwise(0)).alias("cut_ms"), F.sum(F.when(story, F.col("duration_ms")).otherwise(0)).alias("story_kept_ms"), *(count(F.col("silence_type") == t).alias(f"{t}_count") for t in types),
    )


def pacing(timeline: DataFrame, clips: DataFrame) -> DataFrame:
    """Pacing score in 0..1 of clips(source_id, original_ms, output_ms, flow, interest, hook, context, quality)."""
    length = F.greatest(F.lit(0), "duration_ms")
    cut, kept = F.col("decision") == "cut", F.col("decision").isin("soft_keep", "keep_for_story") & F.col("silence_type").isin("comedic_pause", "emotional_pause", "reaction_pause", "tension_pause")
    total = lambda test: F.sum(F.when(test, length).otherwise(0))
    sums = timeline.groupBy("source_id").agg(total(cut & (F.col("silence_type") == "dead_air")).alias("dead"), total(cut & (F.col("silence_type") == "unknown")).alias("unknown"), total(kept).alias("kept"), F.count_if(cut).alias("cuts"))
    x = clips.join(sums, "source_id", "left").fillna(0, ["dead", "unknown", "kept", "cuts"])
    base = F.greatest(F.lit(1000), "original_ms")
    dead, unknown, kept = (F.col(c) / base for c in ("dead", "unknown", "kept"))
    trimmed = F.when(F.col("original_ms") > 0, F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), F.col("output_ms") / F.col("original_ms")))).otherwise(0.0)
    one = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    flow = one(F.col("flow")) * 0.26 + one(F.col("interest")) * 0.18 + one(F.col("hook")) * 0.12 + one(F.col("context")) * 0.12 + one(F.col("quality")) * 0.08
    flow = flow + F.least(F.lit(1.0), kept * 2.0) * 0.08 + F.least(F.lit(1.0), trimmed * 1.2) * 0.08 + F.least(F.lit(1.0), 1.0 - F.greatest(F.lit(0.0), dead * 1.5 + unknown * 0.75)) * 0.08
    penalty = F.least(F.lit(0.40), dead * 1.7 + unknown * 0.75 + F.greatest(F.lit(0), F.col("cuts") - 1) * 0.025)
    return x.select("source_id", F.round(one(flow - penalty + 0.16), 4).alias("pacing_score"))


def pause_energy(gaps: DataFrame, samples: DataFrame, slot_ms: int = 1_000, full_scale: float = 32768.0) -> DataFrame:
    """gaps(source_id, start_ms, end_ms) with energy in 0..1: the root mean square of samples(source_id, at_ms, value)
    within them; 0 for gaps of 0.1 s or less, or without samples. Gaps and samples meet in slots, on equal keys."""
    slots = gaps.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start_ms") / slot_ms), F.floor((F.col("end_ms") - 1) / slot_ms)))).where("end_ms > start_ms + 100")
    at = samples.select("source_id", "at_ms", F.col("value").cast("double").alias("value"), F.floor(F.col("at_ms") / slot_ms).alias("slot"))
    met = slots.join(at, ["source_id", "slot"]).where("at_ms >= start_ms and at_ms < end_ms")
    sums = met.groupBy("source_id", "start_ms", "end_ms").agg((F.sqrt(F.avg(F.col("value") * F.col("value"))) / full_scale).alias("energy"))
    return gaps.join(sums, ["source_id", "start_ms", "end_ms"], "left").fillna(0.0, ["energy"])


def cut_events(timeline: DataFrame) -> DataFrame:
    """The pauses that are cut, in seconds: (source_id, start, end, duration, silence_type, reason)."""
    seconds = lambda c, n: F.round(F.col(c) / 1000, 3).alias(n)
    return timeline.where("decision = 'cut'").select("source_id", seconds("start_ms", "start"), seconds("end_ms", "end"), seconds("duration_ms", "duration"), F.coalesce("silence_type", F.lit("unknown")).alias("silence_type"), "reason")
