"""Every query against its SQL, over the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from cantera import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    found = db.execute(plans.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    rows = lambda rs, get: Counter(repr([plain(get(r, c)) for c in sorted(columns)]) for r in rs)
    assert rows(df.collect(), lambda r, c: r[c]) == rows(found.fetchall(), lambda r, c: r[columns.index(c)])


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES)
