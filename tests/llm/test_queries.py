"""Queries against the SQL of another engine on the smallest tables."""

import duckdb
import pytest

from rasterfold.llm import registry

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels", "benchmark", "conversations")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()[list(want)]
    key = list(want)
    want, got = (x.astype(object).where(x.notna(), None).sort_values(key[:2]).reset_index(drop=True) for x in (want, got))
    for c in key:
        for a, b in zip(want[c], got[c], strict=True):
            assert a == b or abs(a - b) < 1e-9
