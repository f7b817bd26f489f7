"""The library without its optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); assert 'flat_bill_rank' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"


def test_entry_point_works_without_the_text_operators(tmp_path):
    shutil.copytree(ROOT / "meterflow", tmp_path / "meterflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    assert subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True).returncode == 0


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "meterflow").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in [w for line in p.read_text().splitlines() if "import" in line for w in line.replace(".", " ").split()], p
