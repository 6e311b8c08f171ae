"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from inkmark.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(plain(x[i]) for i in order) for x in values), key=repr)


def test_every_query_with_sql_is_registered():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    expected = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, expected.fetchall())
