"""The entry point, with the training-text operators and without."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "orderweave").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"orderweave\.llm|from \.+llm", p.read_text()), p


def test_entry_without_the_subpackage(tmp_path):
    for name in ("orderweave", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "orderweave" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'link_flagship' in q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
