"""The driver's entry points, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["change_sequence", "sources", "source_count"] and df.count() > 0


def test_every_counterpart_has_its_query():
    queries = __spark_entry__.queries()
    assert len(queries) > 40 and set(__spark_entry__.oracle_sql()) <= set(queries)


def test_imports_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "tidemark"):
        source = os.path.join(ROOT, name)
        copy = shutil.copytree if os.path.isdir(source) else shutil.copy
        copy(source, tmp_path / name)
    shutil.rmtree(tmp_path / "tidemark" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
