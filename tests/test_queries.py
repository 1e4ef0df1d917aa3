import glob
import math
import os

import duckdb
import pytest

from postlode.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return str(v) if v is not None else None


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted([tuple(plain(r[c]) for c in columns) for r in found.collect()], key=str)
    if name in SQL:
        told = duck.execute(SQL[name])
        names = [d[0] for d in told.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted([tuple(plain(r[i]) for i in at) for r in told.fetchall()], key=str)
