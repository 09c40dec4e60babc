"""Every registered query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from caselode.plans.catalog import ORACLES, QUERIES
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else round(float(v), 5)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    if name not in ORACLES:
        assert got
        return
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows([[r[i] for i in order] for r in found.fetchall()]) == got
