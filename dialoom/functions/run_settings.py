"""The settings of a whole run, brought into their bounds; dialoom.functions.settings has those of single operators."""

from __future__ import annotations

from typing import Any

#: Numbers and their bounds as (default, least, most). A bound may be another setting above it.
NUMBERS: dict[str, tuple[float, float | str, float | str]] = {
    "max_shorts": (50, 1, 50),
    "review_fast_output_cap": (8, 8, 12), "review_fast_story_candidate_cap": (24, 8, 40), "review_fast_reframe_soft_timeout_seconds": (24.0, 8.0, 30.0), "review_fast_reframe_hard_timeout_seconds": (40.0, 12.0, 45.0),
    "review_pass_min_outputs": (10, 4, 20), "review_pass_output_cap": (20, "review_pass_min_outputs", 25), "review_pass_face_floor": (0.10, 0.06, 0.24), "review_pass_min_speech_density": (0.14, 0.08, 0.30),
    "review_pass_chain_gap_seconds": (72.0, 12.0, 120.0), "review_pass_macro_window_seconds": (600, 180, 1200), "review_pass_max_chain_windows": (4, 2, 6), "review_pass_max_stitched_seconds": (60.0, 30.0, 60.0),
    "segment_merge_gap_seconds": (1.0, 0.35, 2.5), "segment_merge_semantic_threshold": (0.56, 0.34, 0.88), "story_thread_window_seconds": (24.0, 12.0, 48.0), "story_coherence_threshold": (0.62, 0.42, 0.88),
    "clarity_threshold": (0.56, 0.40, 0.92), "duration_floor_penalty": (0.22, 0.10, 0.50), "keep_dialogue_gap_seconds": (1.0, 1.0, 1.4),
    "selection_admission_fraction": (0.20, 0.10, 0.35), "selection_admission_min_pool": (6, 4, 12), "selection_admission_max_pool": (48, "selection_admission_min_pool", 64),
    "tension_context_window_seconds": (1200, 600, 1800), "tension_target_story_seconds": (45, 35, 60), "tension_min_story_seconds": (35, 35, "tension_target_story_seconds"), "tension_story_soft_max_seconds": (60, "tension_target_story_seconds", 60),
    "tension_story_hard_max_seconds": (60, "tension_story_soft_max_seconds", 60), "tension_exceptional_target_seconds": (60, "tension_target_story_seconds", "tension_story_hard_max_seconds"), "tension_exceptional_max_seconds": (60, "tension_story_soft_max_seconds", 60),
    "tension_pause_cut_threshold_seconds": (1.0, 1.0, 1.4), "tension_pause_keep_max_seconds": (1.15, "tension_pause_cut_threshold_seconds", 1.6), "tension_dialogue_compact_lead_pad_seconds": (0.06, 0.02, 0.18), "tension_dialogue_compact_tail_pad_seconds": (0.08, 0.02, 0.18),
    "tension_admission_fraction": (0.24, "selection_admission_fraction", 0.40),
    "subtitle_persist_gap_seconds": (0.85, 0.18, 0.85), "subtitle_clear_gap_seconds": (1.80, "subtitle_persist_gap_seconds", 2.0),
    "story_pause_cut_threshold_seconds": (2.0, 1.0, 2.2), "story_pause_keep_max_seconds": (1.15, "story_pause_cut_threshold_seconds", 1.6), "story_extension_max_pause_seconds": (1.15, "story_pause_cut_threshold_seconds", 2.6), "story_merge_gap_seconds": (1.0, 1.0, 1.6),
    "candidate_window_seconds": (35, 35, 60), "candidate_step_seconds": (10, 8, 20), "max_candidates_for_rerank": (5, 4, 5), "max_candidates_for_semantic_preview": (12, 8, 12),
    "ranking_visual_precheck_seconds": (8.0, 3.0, 12.0), "ranking_visual_precheck_fps": (1.0, 1.0, 2.0), "final_crop_visual_probe_seconds": (8.0, 2.0, 12.0), "final_crop_visual_probe_fps": (1.0, 0.5, 2.0),
}
#: Settings that no run may change.
FIXED: dict[str, Any] = {
    "review_fast_mode_enabled": False, "review_pass_enabled": False, "target_story_min_seconds": 35, "target_story_seconds": 45, "story_soft_max_seconds": 60, "story_window_min_seconds": 35, "story_window_max_seconds": 60,
    "story_hard_max_seconds": 60, "story_strong_target_seconds": 45, "story_strong_max_seconds": 60, "story_exceptional_target_seconds": 60, "story_exceptional_max_seconds": 60, "min_publishable_seconds": 35,
    "min_exceptional_publishable_seconds": 35, "max_short_seconds": 60, "allow_story_extension_seconds": 60, "ranking_pool_cap": 18, "ranking_rerank_short_goal_cap": 5, "ranking_large_pool_timeout_threshold": 18,
    "ranking_large_pool_soft_timeout_seconds": 18, "ranking_large_pool_hard_timeout_seconds": 24, "ranking_fast_pool_multiplier": 2, "ranking_fast_pool_min": 10, "ranking_soft_timeout_seconds": 24, "ranking_hard_timeout_seconds": 30,
}
#: Switches and their defaults.
SWITCHES: dict[str, bool] = {
    "fallback_story_window_enabled": True, "tension_square_canvas_conflict_only": True, "subtitle_hide_when_silent": True, "title_include_hashtags": True, "ranking_visual_precheck_enabled": True, "final_crop_visual_probe_enabled": True,
    "story_stitching_enabled": False, "story_extension_bonus_enabled": False, "publishable_story_override_enabled": False, "reframe_scene_interest_fallback": False, "reframe_listener_face_fallback": False,
    "dialogue_two_shot_preferred": True, "speaker_lock_strict_mode": False, "speaker_center_strict_mode": False,
}
#: Names to choose from, the default first; other names become it.
CHOICES: dict[str, tuple[str, ...]] = {
    "story_mode": ("standard", "auto", "tension"), "subtitle_continuity_mode": ("always_on_short_gaps", "always_on", "off"), "title_style": ("context_clean", "dramatic", "retention_soft"),
}
#: Names that may be any, their defaults, and old names with the ones that took their place.
NAMES: dict[str, str] = {"remote_quality_fallback": "off", "speaker_selection_mode": "evidence_scored", "active_speaker_scan_profile": "light", "subtitle_processing_mode": "balanced_local", "reframe_priority": "stability_first"}
RENAMED: dict[tuple[str, str], str] = {("title_style", "viral_soft"): "retention_soft", ("active_speaker_scan_profile", "episode_light"): "light"}
VERSION = "0.8.5-dev"


def bounded(given: dict[str, Any], name: str, done: dict[str, Any]) -> float:
    """A number within its bounds; one that is missing, 0 or unreadable is the default first."""
    default, *ends = NUMBERS[name]
    low, high = (done[x] if isinstance(x, str) else x for x in ends)
    try:
        value = type(default)(given.get(name) or default)
    except (TypeError, ValueError):
        value = default
    return max(low, min(value, high))


def run_settings(given: dict[str, Any] | None = None) -> dict[str, Any]:
    """All settings of a run; those that aren't known pass through."""
    given = dict(given or {})
    out: dict[str, Any] = {**given, **FIXED, **{k: bool(given.get(k, v)) for k, v in SWITCHES.items()}}
    for name in NUMBERS:
        out[name] = bounded(given, name, out)
    for name in (*CHOICES, *NAMES):
        value = given.get(name)
        if name == "remote_quality_fallback" and isinstance(value, bool):
            value = "manual" if value else "off"
        value = str(value or (CHOICES[name][0] if name in CHOICES else NAMES[name]))
        value = RENAMED.get((name, value.lower()), value)
        out[name] = value if name in NAMES else value.lower() if value.lower() in CHOICES[name] else CHOICES[name][0]
    if out["subtitle_hide_when_silent"] and out["subtitle_continuity_mode"] == "always_on":
        out["subtitle_continuity_mode"] = "always_on_short_gaps"
    tags = int(given.get("title_max_hashtags", 2) or 2)
    out["title_max_hashtags"] = max(2 if out["title_include_hashtags"] else 0, min(tags, 3))
    return out


def identity(settings: dict[str, Any] | None = None, commit: str | None = None) -> dict[str, str | None]:
    """What tells runs apart: the version of the rules, the hash of the settings (places and the language of the window
    aside) and the commit they ran at."""
    import hashlib
    import json

    kept = {k: v for k, v in (settings or {}).items() if k not in ("output_root", "ui_language")}
    text = json.dumps(kept, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)
    return {"pipeline_version": VERSION, "config_hash": hashlib.sha1(text.encode("utf-8", "ignore")).hexdigest()[:8], "git_commit": commit}
