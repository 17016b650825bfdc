from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import TABLES, rows_of
from workload.oracle import ORACLE
from workload.queries import QUERIES

FOLDER = Path("/root/testdata/sf0.001")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())
    assert len(QUERIES) > 100


def test_entry_is_lazy_and_has_a_stable_schema(spark):
    df = contract.entry(spark)
    assert df.columns[-4:] == ["mean", "median", "lower", "upper"]
    assert df.columns == contract.entry(spark).columns


@pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not here")
@pytest.mark.parametrize("key", sorted(QUERIES))
def test_same_rows_as_sql(spark, key):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[key](spark, str(FOLDER))
    cur = db.execute(ORACLE[key])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())
