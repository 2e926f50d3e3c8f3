"""The queries that SQL can express against DuckDB."""

import pytest
from test_queries import duck, plain  # noqa: F401

from citeweave.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_llm_query_equals_sql(spark, sf, duck, name):  # noqa: F811
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    expected = sorted(str(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    assert sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == expected
