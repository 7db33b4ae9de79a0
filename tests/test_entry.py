"""The driver's contract: names, schemas, and that the rest works without the optional operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as e


def test_registered():
    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and "identify_batch" in names


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_works_without_optional_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(e.__file__))
    for name in ("__spark_entry__.py", "skuscope"):
        source = os.path.join(root, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "skuscope" / "llm", ignore_errors=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[1:] == ["False", "False"] and int(out.stdout.split()[0]) > 40, out.stderr
