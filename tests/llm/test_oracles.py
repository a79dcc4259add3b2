"""Each query with SQL against DuckDB on sf0.001."""

import pytest

from quarry.llm.registry import oracle_sql, queries
from tests.conftest import SF
from tools.check_oracle import digest


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(want)
    assert digest(df.columns, rows)[0] == digest(cols, want)[0]
