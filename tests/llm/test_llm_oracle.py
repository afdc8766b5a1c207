"""Registered training-data queries against their DuckDB statements on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from murmuration.llm import queries
from murmuration.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_all_ten_and_the_pipeline_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(queries.ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    res = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, res.fetchall()))
