import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in __spark_entry__.queries() if n in __spark_entry__.oracle_sql() and not n.startswith("op") and n != "pipeline"]


def norm(rows):
    def one(x):
        return None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, DATA)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert norm(got.select(*columns).collect()) == norm(want.select(*columns).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_names_itself():
    assert os.path.exists(DATA) and len(NAMES) >= 90
