"""Registered queries of the training-data operators against their SQL."""

import pytest

from oracle import duck, rows_of
from plotline.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = rows_of(cols, res.fetchall())
    assert len(got) == len(want) > 0
    assert [x for x in zip(got, want) if x[0] != x[1]][:3] == []
