"""The library and its registered queries do not need the document operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
LIST = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"


def test_everything_else_works_without_the_document_operators(tmp_path):
    for name in ("__spark_entry__.py", "switchboard"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "switchboard" / "llm", ignore_errors=True)
    command = [sys.executable, "-c", LIST]
    done = subprocess.run(command, cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    names = done.stdout.split()
    assert "callers_all" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]


def test_an_error_inside_the_document_operators_is_not_hidden(tmp_path):
    for name in ("__spark_entry__.py", "switchboard"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    command = [sys.executable, "-c", LIST]
    done = subprocess.run(command, cwd=tmp_path, capture_output=True, text=True, check=False)
    assert "no_such_module" in done.stderr
