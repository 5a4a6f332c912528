"""The entry module works with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder), "HOME": str(folder)})
    assert out.returncode == 0, out.stderr
    return set(out.stdout.split())


def test_entry_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    kept = names(copy)
    assert "val_eval" in kept and not any(n.startswith("op") or n == "pipeline" for n in kept)
    assert kept <= names(ROOT)


def test_nothing_else_imports_the_subpackage():
    for path in [*(ROOT / "docketry").rglob("*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != Path(__file__).name:
            assert ".llm" not in path.read_text() and "import llm" not in path.read_text(), path
