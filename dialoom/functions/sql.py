"""Operators as SQL functions: scalar ones that Catalyst inlines, table functions, and a Python table function for runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from . import lexicons


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def held(values: Sequence[str]) -> str:
    return f"size(filter(array({', '.join(map(quoted, values))}), s -> contains(lower(text), s)))"


#: Name: arguments, type, body. Bodies say what the column functions of the same names say.
SCALARS = {
    "dl_squeeze": ("text STRING", "STRING", r"trim(regexp_replace(coalesce(text, ''), '\\s+', ' '))"),
    "dl_word_count": ("text STRING", "INT", "CASE WHEN dl_squeeze(text) = '' THEN 0 ELSE size(split(dl_squeeze(text), ' ')) END"),
    "dl_turn_type": (
        "text STRING", "STRING",
        r"""CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN text RLIKE '\\?\\s*["\'»]?\\s*$' THEN 'question' WHEN text RLIKE '!\\s*["\'»]?\\s*$' THEN 'exclamation' WHEN dl_word_count(text) <= 3 THEN 'short_reply' ELSE 'statement' END""",
    ),
    "dl_timestamp": ("ms BIGINT", "STRING", "concat(lpad(ms DIV 3600000, 2, '0'), ':', lpad(ms DIV 60000 % 60, 2, '0'), ':', lpad(ms DIV 1000 % 60, 2, '0'), ',', lpad(ms % 1000, 3, '0'))"),
}
#: Name: the word list whose share a text holds.
SCORES = {"dl_hook_score": lexicons.HOOK, "dl_conflict_score": lexicons.CONFLICT, "dl_escalation_score": lexicons.ESCALATION, "dl_emotion_score": lexicons.EMOTION, "dl_payoff_score": lexicons.PAYOFF}
TABLES = {
    "dl_grid": (
        "total_ms BIGINT, width_ms BIGINT, step_ms BIGINT", "start_ms BIGINT, end_ms BIGINT",
        "SELECT s, least(total_ms, s + width_ms) FROM (SELECT explode(CASE WHEN total_ms > 0 THEN sequence(0L, total_ms - 1, step_ms) END) AS s)",
    ),
}


@udtf(returnType="source_id bigint, run bigint, key string, start_ms bigint, end_ms bigint, n bigint")
class Runs:
    """Consecutive rows of one key of TABLE(...) PARTITION BY source_id ORDER BY ...; columns source_id, key, start_ms, end_ms.
    Only the open run is held."""

    def __init__(self) -> None:
        self.run, self.open = 0, None

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.open and self.open[2] == row["key"]:
            self.open = (*self.open[:4], row["end_ms"], self.open[5] + 1)
            return
        if self.open:
            yield self.open
        self.run += 1
        self.open = (row["source_id"], self.run, row["key"], row["start_ms"], row["end_ms"], 1)

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            yield self.open


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL: dl_squeeze, dl_word_count, dl_turn_type, dl_timestamp, scores of word
    lists, dl_grid(...) and dl_runs(TABLE(...))."""
    for name, (arguments, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    for name, values in SCORES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS DOUBLE RETURN {held(values)} / {float(len(values))}D")
    for name, (arguments, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")
    spark.udtf.register("dl_runs", Runs)
