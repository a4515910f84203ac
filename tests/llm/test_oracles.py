"""The registered queries that SQL can express, against it; the names of all of them."""

import duckdb
import pytest

from tidelog.llm import entry
from tidelog.llm.oracles import ORACLES


def test_names():
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 11)), "pipeline"} and ORACLES.keys() <= names.keys()


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, name):
    at = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    got = entry.queries()[name](spark, at)
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
