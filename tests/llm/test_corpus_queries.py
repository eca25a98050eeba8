"""Every query of the corpus operators that SQL can express against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from playlore.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _norm(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(_norm(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    want = sorted((tuple(_norm(v) for v in r) for r in con.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})").fetchall()), key=repr)
    assert got == want
