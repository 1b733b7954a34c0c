"""Run settings on the driver: defaults, bounds, and a hash that tells runs with other settings apart."""

from __future__ import annotations

import hashlib
import json
from typing import Any

#: Setting: default, least, most. Values outside are moved to the bound; unreadable ones become the default.
BOUNDS: dict[str, tuple[float, float, float]] = {
    "story_max_gap_seconds": (3.5, 0.5, 30.0), "story_min_seconds": (35.0, 6.0, 120.0), "payoff_window_seconds": (180.0, 10.0, 600.0), "max_fragments": (6, 1, 24),
    "caption_max_chars": (34, 16, 80), "caption_max_words": (6, 1, 20), "caption_persist_seconds": (1.2, 0.18, 6.0), "caption_ttl_seconds": (2.2, 0.55, 10.0), "caption_hold_seconds": (0.9, 0.02, 3.0),
    "pause_cut_seconds": (1.0, 1.0, 5.0), "pause_keep_seconds": (1.15, 1.0, 6.0), "overlap_limit": (0.4, 0.0, 1.0), "max_outputs": (5, 1, 100),
}
#: Settings that say where a run writes, not what it computes.
PLACES = ("output_root", "log_root")


def normalized(given: dict[str, Any] | None = None) -> dict[str, Any]:
    """All settings within bounds; the pause that is kept is no shorter than the one that is cut. Others pass through."""
    out = dict(given or {})
    for name, (default, low, high) in BOUNDS.items():
        try:
            value = float(out.get(name, default))
        except (TypeError, ValueError):
            value = default
        out[name] = type(default)(min(high, max(low, value)))
    out["pause_keep_seconds"] = max(out["pause_keep_seconds"], out["pause_cut_seconds"])
    return out


def settings_hash(settings: dict[str, Any]) -> str:
    """Eight hex digits of the settings as sorted compact JSON, places aside."""
    kept = {k: v for k, v in settings.items() if k not in PLACES}
    return hashlib.sha1(json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:8]


def read_settings(path: str) -> dict[str, Any]:
    """Settings of a YAML file, normalized; a file that is missing or unreadable gives the defaults."""
    try:
        import yaml

        with open(path, encoding="utf-8") as file:
            given = yaml.safe_load(file)
    except Exception:  # any fault of the file means defaults
        given = None
    return normalized(given if isinstance(given, dict) else None)


def write_settings(path: str, settings: dict[str, Any]) -> None:
    """Writes normalized settings as YAML, in their order and with letters as they are."""
    import yaml

    with open(path, "w", encoding="utf-8") as file:
        yaml.safe_dump(normalized(settings), file, allow_unicode=True, sort_keys=False)
