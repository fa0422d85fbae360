"""Every reference query against its DuckDB oracle on the smallest tables, and the entry without a session."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from lodestar.plans import catalog
from tests.conftest import ROOT, SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


#: Queries that SQL cannot express; each has a brute-force test of its own.
WITHOUT_SQL = {"chunk_topics"}


def test_all_others_have_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == WITHOUT_SQL and set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_oracle(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SMALL)
    found = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(columns)
    got = sorted(plain([row[c] for c in sorted(columns)]) for row in (r.asDict(True) for r in frame.collect()))
    assert got == sorted(plain([row[columns.index(c)] for c in sorted(columns)]) for row in found.fetchall())


def test_entry_imports_before_a_session_exists():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_without_the_training_data_operators(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "lodestar", ".git", "tests"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "lodestar")
    for name in os.listdir(f"{ROOT}/lodestar"):
        if name != "llm":
            os.symlink(f"{ROOT}/lodestar/{name}", tmp_path / "lodestar" / name)
    code = "import __spark_entry__ as e; from lodestar.plans import catalog; assert set(e.queries()) == set(catalog.QUERIES)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    entry = tmp_path / "__spark_entry__.py"
    text = entry.read_text()
    entry.unlink()
    entry.write_text(text)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
