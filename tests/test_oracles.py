"""Every query with SQL gives the SQL's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from evidencelake.plans.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(set(oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or v != v else str(v)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = queries()[name](spark, SF)
    columns = sorted(got.columns)
    rel = duck.execute(oracle_sql()[name])
    order = [d[0] for d in rel.description]
    assert sorted(order) == columns
    want = [tuple(plain(row[order.index(c)]) for c in columns) for row in rel.fetchall()]
    have = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    key = lambda rows: sorted(rows, key=str)
    assert key(have) == key(want)
