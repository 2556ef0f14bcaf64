"""Every query over the driver's tables against its SQL."""

import shutil
import subprocess
import sys

import pytest

from voxlake.plans.queries import QUERIES, SQL

from .conftest import ROOT
from .oracle import DATA, assert_same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    if not DATA.exists():
        pytest.skip("the driver's tables aren't here")
    assert QUERIES[name](spark, str(DATA)).limit(1).count() == 1


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    if DATA.exists():
        assert entry.entry(spark).columns == ["run", "fwd", "fwd_clean", "lost", "total"]


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_points_without_the_corpus_operators(tmp_path, with_pipeline):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    if not with_pipeline:
        (at / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.tables.QUERIES), sorted(e.oracle_sql()) == sorted(e.tables.SQL))"
    done = subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(at)}, check=False)
    assert done.stdout.split() == ["True", "True"], done.stderr[-500:]
