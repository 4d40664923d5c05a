"""The corpus operators are an optional part: nothing else imports them, and the rest works without them."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "starloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"import .*\bllm\b|from .*\bllm\b", path.read_text()), path


def test_entry_without_them(tmp_path):
    for name in ("starloom", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; names = e.queries(); assert len(names) > 50 and 'pipeline' not in names and not any(n.startswith('op') for n in names); assert e.oracle_sql().keys() <= names.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
