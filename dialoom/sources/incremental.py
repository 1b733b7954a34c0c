"""Runs that work only on inputs that are new or changed since the last one, or whose parameters are."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.settings import settings_hash

#: What tells versions of an input apart, with the hash of the parameters.
KEY = ["path", "length", "modified", "parameters"]
MANIFEST = "path string, length long, modified timestamp, parameters string, run string, done timestamp"


def inputs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modified) of a folder's files but empty ones; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def done(spark: SparkSession, store: str) -> DataFrame:
    """The manifest of a store; empty where there was no run yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{store}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def pending(files: DataFrame, store: str, parameters: dict[str, Any]) -> DataFrame:
    """The files(path, length, modified) that no finished run with these parameters has seen as they are."""
    known = done(files.sparkSession, store).select(*KEY).distinct()
    return files.withColumn("parameters", F.lit(settings_hash(parameters))).join(known, KEY, "left_anti")


def run(files: DataFrame, store: str, parameters: dict[str, Any], work: Callable[[DataFrame], DataFrame]) -> int:
    """Lets `work` make rows (path, ...) of the pending files, writes them and then the manifest; gives the count of files.

    A run's folder is named by a digest of what it works on. So one that was broken off before its manifest is written
    works on the same files when it is run again and replaces its own folder: no row is there twice."""
    todo = pending(files, store, parameters)
    count, digest = todo.agg(F.count("*"), F.bit_xor(F.xxhash64(*KEY))).first()
    if not count:
        return 0
    name = f"{settings_hash(parameters)}-{digest & (1 << 64) - 1:016x}-{count}"
    work(todo).join(todo.select(*KEY), "path").write.mode("overwrite").parquet(f"{store}/results/run={name}")
    todo.withColumns({"run": F.lit(name), "done": F.current_timestamp()}).coalesce(1).write.mode("append").parquet(f"{store}/manifest")
    return count


def results(files: DataFrame, store: str, parameters: dict[str, Any]) -> DataFrame:
    """The rows of the files as they are now, with these parameters: those of runs that the manifest knows."""
    spark = files.sparkSession
    current = files.withColumn("parameters", F.lit(settings_hash(parameters))).join(done(spark, store).select(*KEY, "run"), KEY)
    rows = spark.read.option("basePath", f"{store}/results").option("mergeSchema", True).parquet(f"{store}/results")
    return rows.join(current.select(*KEY, "run").distinct(), [*KEY, "run"]).drop("run", "length", "modified", "parameters")
