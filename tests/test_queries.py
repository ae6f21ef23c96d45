"""Every analyser query with SQL against DuckDB on the smallest tables, and the guard of the optional part."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from morphspark.plans import queries

SF = "/root/testdata/sf0.001"
SQL = queries.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == columns
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {r.lang for r in rows} == {"en", "de", "fr", "es"}


def test_without_the_optional_part(tmp_path):
    root = Path(__file__).parents[1]
    for p in root.rglob("*.py"):
        rel = p.relative_to(root)
        if "llm" not in rel.parts and rel.name != "corpus_pipeline.py":
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'token_counts_by_lang' in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
