"""Corpora of candidate manifests: precedence of fields, export and import, comparison, audit and gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .reporting import SUFFICIENCY_WARNINGS, compare_runs, sufficiency


def named(column: Column) -> Column:
    """Null for an empty text, which doesn't count as given."""
    return F.nullif(column, F.lit(""))


def path_part(path: Column, parent: bool) -> Column:
    """The stem of a path's last part, or the name of the folder it is in."""
    slashed = F.regexp_replace(path, r"\\", "/")
    stem = F.regexp_replace(F.regexp_extract(slashed, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(named(F.regexp_extract(slashed, r"([^/]+)/[^/]*$", 1)), stem) if parent else stem


def manifests(records: DataFrame, report: str = "report", now: Column | None = None) -> DataFrame:
    """records with candidate_id, source_file, series_name, episode_name, created_at, pipeline_version, config_hash and
    git_commit by precedence: the row's own field, that of its struct `report`, what the source's path says, now; and
    duration, clarity_score, merge_reason, human_labels and failure_reason with their fallbacks. Fields that records lack
    count as missing."""
    columns, told = set(records.columns), set(records.schema[report].dataType.names) if report in records.columns else set()
    own = lambda n: named(F.col(n).cast("string")) if n in columns else F.lit(None).cast("string")
    from_report = lambda n: named(F.col(f"{report}.{n}").cast("string")) if n in told else F.lit(None).cast("string")
    number = lambda *names: F.coalesce(*(F.col(n).cast("double") for n in names if n in columns), F.lit(0.0))
    source = F.coalesce(own("source_file"), from_report("source_file"))
    hook = F.col("summary.hook_score") if "summary" in columns else F.lit(0.0)
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss+00:00") if now is None else now
    fields = {
        "source_file": source, "series_name": F.coalesce(own("series_name"), from_report("series_name"), path_part(source, parent=True), F.lit("")),
        "episode_name": F.coalesce(own("episode_name"), from_report("episode_name"), path_part(source, parent=False), F.lit("")), "created_at": F.coalesce(own("created_at"), stamp),
    }
    fields |= {n: F.coalesce(own(n), from_report(n)) for n in ("pipeline_version", "config_hash", "git_commit")}
    clarity = [F.col(n).cast("double") for n in ("clarity_score", "story_clarity_score") if n in columns]
    fields |= {"duration": F.round(number("final_duration", "duration"), 3), "clarity_score": F.coalesce(*clarity, hook, F.lit(0.0)), "merge_reason": F.coalesce(own("merge_reason"), own("stitch_reason"))}
    return records.withColumns(fields)


def write_corpus(rows: DataFrame, path: str) -> None:
    """Exports manifests as JSON lines; they are added to what is there."""
    rows.write.mode("append").json(path)


def read_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Imports manifests; rows that repeat a candidate_id are one, the latest by created_at."""
    rows = spark.read.schema(schema).json(path)
    packed = F.struct(*(F.col(c) for c in rows.columns if c != "candidate_id"))
    return rows.groupBy("candidate_id").agg(F.max_by(packed, F.struct("created_at", F.xxhash64(packed))).alias("r")).select("candidate_id", "r.*")


def audit(candidates: DataFrame, golden: DataFrame) -> DataFrame:
    """One row: count, candidate_count, golden_count, how many ids are in both, and status by the number reviewed."""
    rows = candidates.select("candidate_id", F.lit("candidate").alias("origin")).unionByName(golden.select("candidate_id", F.lit("golden").alias("origin")))
    ids = rows.groupBy("candidate_id").agg(F.count_if(F.col("origin") == "candidate").alias("c"), F.count_if(F.col("origin") == "golden").alias("g"))
    sums = ids.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("candidate_count", F.col("c")), ("golden_count", F.col("g")), ("shared", F.when((F.col("c") > 0) & (F.col("g") > 0), 1).otherwise(0)))))
    return sums.select((F.col("candidate_count") + F.col("golden_count")).alias("count"), "candidate_count", "golden_count", F.col("shared").cast("long").alias("shared"), sufficiency(F.col("candidate_count") + F.col("golden_count")).alias("status"))


def compare(before: DataFrame, after: DataFrame, small: int = 20) -> DataFrame:
    """compare_runs() of two tables (metric, value), with a warning where either's `count` is below `small`."""
    both = compare_runs(before, after)
    few = F.least(F.coalesce("before", F.lit(0.0)), F.coalesce("after", F.lit(0.0))) < small
    return both.withColumn("warning", F.when((F.col("metric") == "count") & few, "small_sample_size"))


def gate(reviewed: DataFrame) -> DataFrame:
    """One row (reviewed, status, warning, exit_code) of a corpus: exit_code is 2 while it is weak, else 0."""
    known = F.create_map(*(F.lit(x) for pair in SUFFICIENCY_WARNINGS.items() for x in pair))
    found = reviewed.agg(F.count("*").alias("reviewed")).withColumn("status", sufficiency(F.col("reviewed")))
    return found.withColumns({"warning": F.try_element_at(known, F.col("status")), "exit_code": F.when(F.col("status") == "weak", 2).otherwise(0)})


def review_queue(candidates: DataFrame, most: int) -> DataFrame:
    """The `most` candidates that wait for review, the least sure by recommendation_readiness_score first."""
    waiting = candidates.where(F.coalesce(F.size("human_labels"), F.lit(0)) <= 0)
    return waiting.orderBy(F.abs(F.coalesce("recommendation_readiness_score", F.lit(0.0)) - 0.64), "candidate_id").limit(most)


def joined_metadata(outputs: DataFrame, metadata: DataFrame) -> DataFrame:
    """outputs(metadata, ...) with the fields of metadata(path, ...) of the same path, null where there is none."""
    return outputs.join(metadata.withColumnRenamed("path", "metadata"), "metadata", "left")


def debug_snapshot(records: DataFrame) -> DataFrame:
    """The fields by which a montage is inspected: texts '' and numbers 0 where they are missing."""
    columns = set(records.columns)
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in columns else F.lit("")
    number = lambda *ns: F.coalesce(*(F.col(n).cast("double") for n in ns if n in columns), F.lit(0.0))
    texts = ("candidate_id", "conversation_id", "story_thread_id", "story_arc_shape")
    scores = ("story_completion_score", "context_completeness_score", "hook_score", "story_coherence_score", "speaker_confidence_score", "visual_conversation_score")
    return records.select(*(text(n).alias(n) for n in texts), *(number(n).alias(n) for n in scores), number("payoff_score", "payoff_strength").alias("payoff_score"), F.coalesce(F.col("needs_review"), F.lit(False)).alias("needs_review"))


def reframe_summary(debug: DataFrame) -> DataFrame:
    """debug with listener_reaction_count: the more of listener windows and of switches to a listener."""
    return debug.withColumn("listener_reaction_count", F.greatest(F.coalesce("listener_fallback_windows", F.lit(0)), F.coalesce("speaker_to_listener_switches", F.lit(0))))


def timeline_plan(windows: DataFrame, duration: str = "plan_duration") -> DataFrame:
    """windows marked as planned, with window_duration: the plan's, or the window's own where the plan has none."""
    return windows.withColumns({"timeline_edit_applied": F.lit(True), "window_duration": F.round(F.coalesce(F.nullif(F.col(duration), F.lit(0.0)), F.col("duration"), F.lit(0.0)), 3)})
