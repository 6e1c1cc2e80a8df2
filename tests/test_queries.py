"""Every query with SQL gives the rows that DuckDB gives for it."""

import datetime
import math

import duckdb
import pytest

from docloom.plans.registry import ORACLE_SQL, QUERIES, flagship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x.isoformat() if isinstance(x, datetime.date) else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLE_SQL[name])
    expected = rows([d[0] for d in cur.description], cur.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_flagship_has_rows(spark, sf_dir):
    assert flagship(spark, sf_dir).count() > 0
