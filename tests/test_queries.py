"""Every query of the record store against its SQL, by value."""

import datetime
import math

import duckdb
import pytest

from tidelog.plans.oracles import ORACLES
from tidelog.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v.isoformat() if isinstance(v, datetime.datetime) else v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


def test_each_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    at = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    df = QUERIES[name](spark, at)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())
