"""The driver's entry points, with and without the llm folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'])"


def names(folder):
    return subprocess.run([sys.executable, "-B", "-c", CODE], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.strip()


def test_entry_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "tessera"):
        source = ROOT / name
        if source.exists():  # all but the entry may be gone
            (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "tessera/llm", ignore_errors=True)
    count, whole, rest = names(tmp_path).split(" ", 2)
    assert int(count) > 60 and whole == "True" and rest == "[]"


def test_nothing_outside_imports_llm():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tessera.llm" not in path.read_text(), path


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
