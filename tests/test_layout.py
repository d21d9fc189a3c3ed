"""What is left when the language-data parts are deleted still imports and has its queries."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_imports_without_the_language_data_parts(tmp_path):
    for name in ("textloom", "tests", "__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "textloom/llm")
    if (tmp_path / "tests/llm").exists():
        shutil.rmtree(tmp_path / "tests/llm")
    say = "import __spark_entry__ as e, bench; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    for extra in (None, "corpus_pipeline.py"):
        if extra:
            (tmp_path / extra).unlink()
        out = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True)
        assert out.returncode == 0, out.stderr
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, capture_output=True, text=True)
    assert collected.returncode == 0, collected.stdout


def test_nothing_else_imports_the_language_data_parts():
    for file in (ROOT / "textloom").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT / "textloom").parts:
            assert "textloom.llm" not in file.read_text(), file
