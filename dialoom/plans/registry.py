"""Registration of queries with their oracle SQL, and SQL fragments that oracles share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def whole_numbers_as_long(df: DataFrame) -> DataFrame:
    """Integers as long, so that results have the types of the oracle's."""
    narrow = {c: df[c].cast("long") for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint")}
    return df.withColumns(narrow) if narrow else df


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under its name, with oracle SQL if SQL can express it."""

    def register(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return whole_numbers_as_long(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: Sequence[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def hits(text: str, values: Sequence[str]) -> str:
    """SQL list of the values that a lower-cased text holds."""
    return f"list_filter({listed(values)}, lambda s: contains(lower({text}), s))"


def score(text: str, values: Sequence[str]) -> str:
    return f"len({hits(text, values)}) / {float(len(values))}"


def cascade(text: str, types: Sequence[tuple[str, Sequence[str]]], default: str) -> str:
    """SQL CASE of the first type one of whose stems a text holds; default is SQL."""
    whens = " ".join(f"WHEN len({hits(text, stems)}) > 0 THEN {quoted(name)}" for name, stems in types)
    return f"CASE {whens} ELSE {default} END"


def squeezed(text: str) -> str:
    return rf"trim(regexp_replace(coalesce({text}, ''), '\s+', ' ', 'g'))"


def file_name(title: str, most: int = 110) -> str:
    """SQL of a title as a file name."""
    tidy = rf"replace(regexp_replace({squeezed(title)}, ' +([,.:;!?])', '\1', 'g'), ' - ', ' ')"
    sound = rf"trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({tidy}), '[<>:\"/\\|?*\x00-\x1f]', '', 'g'), '[ .]+$', ''), '\s+', ' ', 'g'))"
    head = f"left({sound}, {most})"
    return f"coalesce(nullif(CASE WHEN length({sound}) <= {most} THEN {sound} ELSE coalesce(nullif(trim(regexp_extract({head}, '^(.*) ', 1)), ''), {head}) END, ''), 'clip')"


SEGMENTS = rf"""seg AS (
  SELECT conv_id AS source_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seg_idx, (e - d)::BIGINT AS start_ms, e::BIGINT AS end_ms, text, role AS speaker
  FROM (SELECT *, sum(d + g) OVER (PARTITION BY conv_id ORDER BY turn) AS e
        FROM (SELECT *, 400 + 300 * len(string_split({squeezed("text")}, ' ')) AS d, (conv_id * 37 + turn * 91) % 60 * 100 AS g FROM conversations)))"""

CLEAN = rf"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '\{{[^}}]+\}}', ' ', 'g'), '\s+', ' ', 'g'))"

TURNS = rf"""{SEGMENTS}, turns AS (
  SELECT source_id, seg_idx AS turn_id, start_ms, greatest(start_ms, end_ms) AS end_ms, {CLEAN} AS text, coalesce(nullif(trim(speaker), ''), 'UNKNOWN') AS speaker FROM seg)"""

TURN_TYPE = r"""CASE WHEN text = '' THEN 'empty' WHEN regexp_matches(text, '\?\s*["''»]?\s*$') THEN 'question' WHEN regexp_matches(text, '!\s*["''»]?\s*$') THEN 'exclamation'
  WHEN len(string_split(text, ' ')) <= 3 THEN 'short_reply' ELSE 'statement' END"""

BLOCKS = rf"""{TURNS}, numbered AS (
  SELECT *, sum(n) OVER (PARTITION BY source_id ORDER BY turn_id)::BIGINT AS block_no
  FROM (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY source_id ORDER BY turn_id) > 3500 THEN 1 ELSE 0 END AS n FROM turns)),
blocks AS (
  SELECT source_id, block_no, arg_min(start_ms, turn_id) AS start_ms, arg_max(end_ms, turn_id) AS end_ms, count(*) AS turn_count,
    list_reduce(list_prepend([]::VARCHAR[], list_transform(list(speaker ORDER BY turn_id), lambda s: [s])), lambda a, s: CASE WHEN list_contains(a, s[1]) THEN a ELSE a || s END) AS speakers,
    string_agg(text, ' ' ORDER BY turn_id) AS text
  FROM numbered GROUP BY source_id, block_no)"""

INTERVALS = """iv AS (
  SELECT user_id AS source_id, event_id AS id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + round(value * 60000)::BIGINT AS end_ms, event_type AS speaker, value AS score FROM events)"""
