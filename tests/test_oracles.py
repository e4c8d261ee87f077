"""Every query with SQL gives the rows of that SQL."""

import duckdb
import pytest

from draftlake.plans.queries import ORACLES, QUERIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(columns), sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = QUERIES[name](spark, DATA)
    said = con.sql(ORACLES[name])
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(said.columns, said.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
