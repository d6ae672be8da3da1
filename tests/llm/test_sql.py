"""Text queries with SQL give what DuckDB gives on the smallest tables."""

import duckdb
import pytest

from tilefold.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        duck.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLES[name])
    names = sorted(expected.columns)
    assert sorted(df.columns) == names
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(expected.select(*names).fetchall())
