"""The driver contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_queries_have_sql_or_are_known():
    import __spark_entry__ as entry
    from tessera.plans import queries

    own = queries.queries()
    assert set(queries.oracle_sql()) <= set(own) <= set(entry.queries())
    assert set(own) == set(queries.oracle_sql())


def test_import_without_the_optional_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'clean_text' in q and not any(k.startswith('op') and k[2:3].isdigit() for k in q), q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver data")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
