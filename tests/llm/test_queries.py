"""Registered queries against their SQL."""

import glob
import os

import duckdb
import pytest

import verify
from jobweave.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = queries.QUERIES[name](spark, FOLDER)
    result = db.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert verify.rows_of(frame.columns, frame.collect()) == verify.rows_of(names, result.fetchall())


def test_every_number_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}
