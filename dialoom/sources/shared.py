"""Tables in the folder that all executors share, which cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications that run on this machine alone, where spark.checkpoint.dir is unset.
LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local master without it gets a temporary folder, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in LOCAL:
            LOCAL[application] = "file://" + tempfile.mkdtemp(prefix="dialoom-")
        found = LOCAL[application]
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once into the shared folder and read back: a lost executor loses nothing of it."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
