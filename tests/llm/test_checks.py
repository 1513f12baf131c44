"""Registered queries against their SQL."""

import pytest
from compare import normalised, oracle_connection

from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cur = oracle_connection(SF).execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    mine, theirs = normalised(df.collect(), df.columns), normalised(cur.fetchall(), columns)
    assert mine == theirs and mine
