"""Every registered query against its SQL twin, on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import TABLES, rows_of

NAMES = sorted(queries())


@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, db, name):
    result = queries()[name](spark, folder)
    mine = rows_of(result.columns, result.collect())
    assert mine
    if name in oracle_sql():
        cursor = db.execute(oracle_sql()[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(result.columns)
        assert mine == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert entry(spark).columns == ["lang", "chunks", "mean_chars"]


def test_twins_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_workers_need_no_copy_of_the_package(tmp_path, folder):
    """A driver that runs elsewhere and only knows the package itself."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "from __spark_entry__ import queries\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "for name in ('generate_batches', 'knn_top5_by_cells', 'embed_documents'):\n"
        f"    assert queries()[name](spark, {folder!r}).count() > 0\n"
    )
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "PYSPARK", "SPARK_"))}
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, check=True, timeout=300)
