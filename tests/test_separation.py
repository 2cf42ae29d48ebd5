"""The library, its queries and its entry module do without the llm subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def imported(root):
    code = "import __spark_entry__ as e; print(len([n for n in e.queries() if n.startswith('op') or n == 'pipeline']), len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(root)})
    assert done.returncode == 0, done.stderr
    return [int(x) for x in done.stdout.split()[-3:]]


def test_entry_without_the_subpackage(tmp_path):
    root = tmp_path / "copy"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    shutil.rmtree(root / "quillspark" / "llm", ignore_errors=True)
    none, some, sql = imported(root)  # corpus_pipeline.py is still there
    assert none == 0 and some > 90 and sql > 90
    (root / "corpus_pipeline.py").unlink(missing_ok=True)
    assert imported(root) == [none, some, sql]
