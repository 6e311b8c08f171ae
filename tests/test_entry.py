"""The driver's contract holds with the optional subpackage and without it."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_without_the_subpackage(tmp_path):
    copy = "import shutil; shutil.copytree('inkmark', r'{0}/inkmark', ignore=shutil.ignore_patterns('llm', '__pycache__')); shutil.copy('__spark_entry__.py', r'{0}')".format(tmp_path)
    subprocess.run([sys.executable, "-c", copy], cwd=ROOT, check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ber' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
