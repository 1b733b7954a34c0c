"""Settings of a run within their bounds."""

import pytest

from dialoom.functions import run_settings as rs


def test_defaults_are_within_bounds_and_stay():
    once = rs.run_settings()
    assert once == rs.run_settings(once) and len(once) >= 90
    for name, (_, *ends) in rs.NUMBERS.items():
        low, high = (once[x] if isinstance(x, str) else x for x in ends)
        assert low <= once[name] and (once[name] <= high or once[name] == low), name
    assert once["story_pause_keep_max_seconds"] == 2.0 and once["title_max_hashtags"] == 2


@pytest.mark.parametrize(("given", "want"), [
    ({"max_shorts": 999, "review_pass_min_outputs": 30, "review_pass_output_cap": 1}, {"max_shorts": 50, "review_pass_min_outputs": 20, "review_pass_output_cap": 20}),
    ({"max_shorts": 0, "candidate_step_seconds": "x", "clarity_threshold": None}, {"max_shorts": 50, "candidate_step_seconds": 10, "clarity_threshold": 0.56}),
    ({"review_pass_enabled": True, "story_hard_max_seconds": 500}, {"review_pass_enabled": False, "story_hard_max_seconds": 60}),
    ({"tension_target_story_seconds": 40, "tension_min_story_seconds": 55}, {"tension_min_story_seconds": 40, "tension_target_story_seconds": 40}),
    ({"title_style": "VIRAL_SOFT", "story_mode": "odd", "active_speaker_scan_profile": "episode_light"}, {"title_style": "retention_soft", "story_mode": "standard", "active_speaker_scan_profile": "light"}),
    ({"subtitle_continuity_mode": "always_on"}, {"subtitle_continuity_mode": "always_on_short_gaps"}),
    ({"subtitle_continuity_mode": "always_on", "subtitle_hide_when_silent": False}, {"subtitle_continuity_mode": "always_on"}),
    ({"remote_quality_fallback": True}, {"remote_quality_fallback": "manual"}),
    ({"remote_quality_fallback": False, "title_include_hashtags": False, "title_max_hashtags": 1, "other": 7}, {"remote_quality_fallback": "off", "title_max_hashtags": 1, "other": 7}),
])
def test_settings_are_moved_into_bounds(given, want):
    found = rs.run_settings(given)
    assert {k: found[k] for k in want} == want


def test_identity_tells_settings_apart_but_not_places():
    one = rs.identity({"a": 1, "output_root": "/x"}, "abc")
    assert one == rs.identity({"a": 1, "ui_language": "en"}, "abc") and one["config_hash"] != rs.identity({"a": 2})["config_hash"] and one["git_commit"] == "abc"
