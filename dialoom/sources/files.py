"""Readers and writers: subtitle files, metadata, feedback log, profiling records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.captions import srt

STAMP = r"(\d+):(\d\d):(\d\d),(\d{3})"


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(file, cue, start_ms, end_ms, text) of SubRip files; blocks without a time line are skipped."""
    blocks = spark.read.text(path, lineSep="\n\n").select(F.col("_metadata.file_path").alias("file"), F.trim(F.regexp_replace("value", r"\r", "")).alias("b"))
    ms = lambda k: sum(F.regexp_extract("b", STAMP + " --> " + STAMP, 4 * k + i).try_cast("long") * unit for i, unit in ((1, 3_600_000), (2, 60_000), (3, 1_000), (4, 1)))
    text = F.regexp_extract("b", r"(?s)-->[^\n]*\n(.*)$", 1)
    return blocks.where(F.col("b").contains("-->")).select("file", F.regexp_extract("b", r"^\s*(\d+)", 1).try_cast("int").alias("cue"), ms(0).alias("start_ms"), ms(1).alias("end_ms"), text.alias("text"))


def write_srt(events: DataFrame, path: str) -> None:
    """One folder source_id=... of text files per source; a source's cues are in order in one file."""
    cues = srt(events).repartition("source_id").sortWithinPartitions("source_id", "cue")
    cues.select("source_id", F.col("srt").alias("value")).write.partitionBy("source_id").mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per file; what doesn't parse or is missing is null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def append_feedback(events: DataFrame, path: str) -> None:
    """Appends events to a JSON-lines log; timestamp_utc is now where it is missing."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    stamp = F.coalesce(F.col("timestamp_utc"), now) if "timestamp_utc" in events.columns else now
    events.withColumn("timestamp_utc", stamp).write.mode("append").json(path)


def stage_timings(spark: SparkSession, path: str) -> DataFrame:
    """(run, stage, n, mean_s, max_s) of run folders' short_*.json files with a map `timings` of seconds."""
    read = spark.read.schema("timings map<string,double>").option("multiLine", True).option("pathGlobFilter", "short_*.json").option("recursiveFileLookup", True).json(path)
    run = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    tall = read.select(run.alias("run"), F.explode("timings").alias("stage", "s"))
    return tall.groupBy("run", "stage").agg(F.count("*").alias("n"), F.round(F.avg("s"), 4).alias("mean_s"), F.max("s").alias("max_s"))


def video_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes of a folder's video files, in order of path; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{mp4,mkv,mov,avi,webm,MP4,MKV,MOV,AVI,WEBM}").load(path)
    return files.select("path", "length", "modificationTime").orderBy("path")


def silence_log(lines: DataFrame) -> DataFrame:
    """(source_id, start_s, end_s) from log lines(source_id, nth, line): each silence_start with the next silence_end."""
    value = lambda kind: F.regexp_extract("line", kind + r":\s*(-?[0-9.]+)", 1).try_cast("double")
    marked = lines.withColumns({"s": value("silence_start"), "e": value("silence_end")}).where("s is not null or e is not null")
    ends = F.lead("e").over(Window.partitionBy("source_id").orderBy("nth"))
    return marked.withColumn("next", ends).where("s is not null and next is not null").select("source_id", F.greatest(F.lit(0.0), "s").alias("start_s"), F.col("next").alias("end_s"))


def placeholder_cues(sources: DataFrame, width_ms: int = 5_000) -> DataFrame:
    """Empty cues of width_ms that cover sources(source_id, total_ms)."""
    from ..operators.intervals import fixed_grid

    return fixed_grid(sources, width_ms).withColumn("text", F.lit("..."))
