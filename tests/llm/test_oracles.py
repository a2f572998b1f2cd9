"""The opN queries against their SQL, over the smallest tables the driver provides."""

import os

import pytest
from tesela.llm.queries import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    base = duckdb.connect()
    for file in os.listdir(TABLES):
        if file.endswith(".parquet"):
            base.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{file}'")
    told = base.execute(ORACLE_SQL[name])
    columns = [d[0] for d in told.description]
    want = sorted(told.fetchall(), key=str)
    assert sorted(map(tuple, QUERIES[name](spark, TABLES).select(columns).collect()), key=str) == want
