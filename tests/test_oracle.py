import glob
import os

import duckdb
import pytest

import __spark_entry__
from recordmill import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    sql = con.sql(plans.ORACLE_SQL[name])
    assert columns == sorted(sql.columns)
    ours = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert ours == sorted(tuple(map(str, r)) for r in sql.project(",".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6
