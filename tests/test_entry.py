import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from docindex.plans import queries as corpus

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


def plain(x):
    """A value as text that is the same from either engine."""
    if x is None or isinstance(x, float) and x != x:
        return "-"
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, list | tuple | np.ndarray):
        return str([plain(v) for v in x])
    return str(x)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


@needs_data
@pytest.mark.parametrize("name", [*corpus.ORACLE_SQL])
def test_sql_twin(spark, tables, name):
    got = corpus.QUERIES[name](spark, str(DATA))
    cursor = tables.execute(corpus.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(tuple(map(plain, r)) for r in cursor.fetchall())
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == want


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(corpus.QUERIES) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_training_data_part(tmp_path):
    root = Path(entry.__file__).parent
    shutil.copytree(root / "docindex", tmp_path / "docindex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n[:2] == 'op'])"
    got = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert got.stdout.split(maxsplit=1) == [str(len(corpus.QUERIES)), "[]\n"], got.stderr
