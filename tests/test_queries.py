"""Every registered query against its SQL, plan checks, and rules for the source."""

import glob
import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import verify
from jobweave.plans import registry

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    frame = entry.queries()[name](spark, FOLDER)
    rows = frame.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert verify.rows_of(frame.columns, rows) == verify.rows_of(names, result.fetchall())


def test_entry_lists_all_queries():
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_optional_subpackage(tmp_path):
    """A copy without it still imports and lists all other queries."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    script = "import __spark_entry__ as e; print('names', len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert f"names {len(registry.QUERIES)} {len(registry.SQL)}" in done.stdout, done.stderr[-2000:]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["search_bm25", "search_hybrid", "search", "suggest", "search_listing", "join_related", "agg_duplicate_groups"])
def test_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_browse_is_a_distributed_top_k(spark):
    text = plan(entry.queries()["browse"](spark, FOLDER))
    assert "TakeOrderedAndProject" in text and "Python" not in text


def test_scan_reads_only_what_it_needs(spark):
    text = plan(entry.queries()["agg_daily_searches"](spark, FOLDER))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(ts", text)


def test_bm25_reads_posting_folders_of_its_words(spark):
    assert "dynamicpruning" in plan(entry.queries()["search_bm25"](spark, FOLDER))


def test_workers_find_the_package_from_any_folder(tmp_path):
    script = (
        "import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "q = e.queries(); print('rows', q['page_links'](s, sys.argv[2]).count(), q['search_semantic'](s, sys.argv[2]).count())"
    )
    done = subprocess.run([sys.executable, "-c", script, ROOT, FOLDER], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_source_rules():
    for path in glob.glob(f"{ROOT}/jobweave/**/*.py", recursive=True):
        source = open(path).read()
        assert "localCheckpoint" not in source and "crossJoin" not in source, path
        if f"{os.sep}operators{os.sep}" in path:
            assert ".toPandas(" not in source, path
