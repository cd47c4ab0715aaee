"""The rest works when the training-data package is taken away."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_imports_without_llm(tmp_path):
    for name in ("__spark_entry__.py",):
        shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pricing_summary' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for p in (ROOT / "lodestone").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text()
