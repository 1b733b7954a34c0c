"""The operators that SQL can express against their oracle SQL."""

import duckdb
import pytest

from dialoom.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    wanted = sorted((tuple(map(str, r)) for r in found.fetchall()))
    got = sorted(tuple(map(str, r)) for r in queries.QUERIES[name](spark, DIR).select(*columns).collect())
    assert got == wanted
