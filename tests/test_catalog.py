"""Every query with SQL against DuckDB; the entry points."""

import os
import subprocess
import sys

import duckdb
import pytest

from gleaner.plans import catalog
from tests.conftest import DATA, ROOT


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return connection


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, DATA)
    got = frame.collect()
    if name not in catalog.oracle_sql():
        assert frame.columns and got is not None
        return
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert _rows(got, frame.columns) == _rows(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.columns[:3] == ["rule_id", "rule_name", "secret"] and frame.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    import shutil

    for name in ("__spark_entry__.py", "gleaner"):
        source = os.path.join(ROOT, name)
        copy = shutil.copytree if os.path.isdir(source) else shutil.copy
        copy(source, tmp_path / name)
    shutil.rmtree(tmp_path / "gleaner" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1') or n == 'pipeline' for n in q); print(len(q), len(e.oracle_sql()))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
