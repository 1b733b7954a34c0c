"""Registered queries of the transcript analytics operators, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from . import dialogue, framed, intervals, previews, records, surface, windows  # noqa: F401  registers their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
