import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

from paperloom.catalog import load_catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WANTED = (
    [f"A{n}" for n in range(1, 7)] + [f"B{n}" for n in range(1, 14)] + [f"C{n}" for n in range(1, 17)]
    + [f"D{n}" for n in range(1, 16)] + [f"E{n}" for n in range(1, 30)] + [f"F{n}" for n in range(1, 15)] + [f"G{n}" for n in range(1, 5)]
)


def test_every_operator_has_a_query():
    covered = {q.covers for q in load_catalog().values()}
    assert not set(WANTED) - covered
    assert all(re.fullmatch("[a-z][a-z0-9_]+", name) for name in load_catalog())


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(name for name, query in load_catalog().items() if query.sql))
def test_spark_and_sql_agree(spark, tables, name):
    query = load_catalog()[name]
    result = tables.execute(query.sql)
    columns = [c[0] for c in result.description]
    df = query.build(spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


@pytest.mark.parametrize("left", ["nothing", "empty folder"])
def test_the_rest_works_without_the_corpus_operators(tmp_path, left):
    """The entry point in a copy without the operators for corpora, with their pipeline still there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "tests", "llm", "__pycache__"))
    if left == "empty folder":
        (copy / "paperloom" / "llm").mkdir()
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100 and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
