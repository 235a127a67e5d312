"""Queries that SQL can express, against DuckDB on values and types."""

import duckdb
import pytest

from cohortscope.llm import catalog
from helpers import shipped  # noqa: F401

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLES[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in order) for r in want.fetchall())
    assert [TYPES[t] for _, t in df.dtypes] == [str(want.types[k]) for k in order]


def test_every_number_has_one_query():
    numbers = [name[2:].split("_")[0] for name in catalog.queries()]
    assert sorted(map(int, numbers)) == [*range(1, 14)]
