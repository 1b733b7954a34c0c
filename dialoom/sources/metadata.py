"""JSON metadata of any shape as VARIANT values, and report files beside what they report on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """A text as a VARIANT; one that is missing or no JSON is an empty object, as unreadable files are."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}")))


def read_any(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, stem, value) of a folder's JSON files, one value a file, whatever their shapes; no schema is needed."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    return files.select(name.alias("path"), F.regexp_extract(name, r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), parsed(F.col("value")).alias("value"))


def first_of(value: Column, paths: list[str], kind: str = "double", default: object = None) -> Column:
    """The first of some paths of a VARIANT that is there and has, or can be read as, a type; else the default."""
    found = [F.try_variant_get(value, p, kind) for p in paths]
    return F.coalesce(*found, F.lit(default).cast(kind))


def shape(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, shape): how many values there are and the type that holds them all."""
    return values.groupBy(*by).agg(F.count("*").alias("n"), F.schema_of_variant_agg("value").alias("shape"))


def write_reports(reports: DataFrame, path: str, ending: str = "phase4_report") -> None:
    """reports(stem, ...) as one JSON line each, in folders stem=<stem>_<ending>: a file a report, written by tasks and
    replaced when it is written again."""
    body = F.to_json(F.struct(*(c for c in reports.columns if c != "stem")), {"ignoreNullFields": "false"})
    named = reports.select(F.concat("stem", F.lit(f"_{ending}")).alias("stem"), body.alias("value"))
    named.repartition("stem").write.option("partitionOverwriteMode", "dynamic").partitionBy("stem").mode("overwrite").text(path)


def caption_reports(files: DataFrame) -> DataFrame:
    """(stem, segments, duration, overlaps, empty, readable) of caption files(stem, value): JSON with `segments`, or a bare
    list of them, of start, end (seconds) and text."""
    rows = F.coalesce(F.try_variant_get("value", "$.segments", "array<struct<start:double,end:double,text:string>>"), F.try_variant_get("value", "$", "array<struct<start:double,end:double,text:string>>"))
    pairs = F.filter(F.transform("s", lambda x, i: (i > 0) & (x["start"] < F.get("s", i - 1)["end"])), lambda x: x)
    spoken = F.round(F.coalesce(F.array_max("s.end") - F.array_min("s.start"), F.lit(0.0)), 3)
    blank = F.size(F.filter("s", lambda x: F.coalesce(F.trim(x["text"]), F.lit("")) == ""))
    return files.withColumn("known", rows).withColumn("s", F.coalesce("known", F.array().cast("array<struct<start:double,end:double,text:string>>"))).select(
        "stem", F.size("s").cast("long").alias("segments"), spoken.alias("duration"), F.size(pairs).cast("long").alias("overlaps"), blank.cast("long").alias("empty"), F.col("known").isNotNull().alias("readable")
    )
