"""Registered queries against their oracle SQL on the smallest tables, and the streaming forms."""

import duckdb
import pandas as pd
import pytest

from dialoom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame) -> list[tuple]:
    show = lambda v: None if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted((tuple(show(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, con, name):
    assert rows(catalog.QUERIES[name](spark, DIR).toPandas()) == rows(con.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_live_counts(spark, tmp_path):
    from pyspark.sql import functions as F

    from dialoom.streaming import live

    events = spark.read.parquet(f"{DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = live.live_counts(stream).writeStream.outputMode("complete").format("memory").queryName("live_counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM live_counts").first()[0] == events.count()
