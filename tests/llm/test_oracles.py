import glob
import os

import duckdb
import pytest

from wardline.llm import oracles, queries

SF = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    have = queries.queries()[name](spark, SF)
    want = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(have.columns) == sorted(names)
    rows = sorted((tuple(norm(r[c]) for c in names) for r in have.collect()), key=str)
    assert rows == sorted((tuple(map(norm, r)) for r in want.fetchall()), key=str)
