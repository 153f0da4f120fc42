"""Every registered query of the library's own operators against DuckDB, or for rows only."""

import pytest

from compare import assert_same, connect
from timeloom import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    sql = queries.oracle_sql().get(name)
    if sql:
        assert_same(df, con, sql)
    else:
        assert len(df.collect()) > 0


def test_every_sql_has_its_query():
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_imports_without_the_text_operators(tmp_path, with_pipeline):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "timeloom", tmp_path / "timeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if with_pipeline:  # its folders are gone: the entry leaves it out
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'segments_rle' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); print(len(q), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": "", "HOME": str(tmp_path)})
    assert out.returncode == 0, out.stderr
