import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_flagship_query(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_corpus_subpackage(tmp_path):
    """No module but the entry names the subpackage, and the entry works when it is gone."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "rosterloom", tmp_path / "rosterloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
    others = [p for p in (ROOT / "rosterloom").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert others and not any("rosterloom.llm" in p.read_text() or "from .llm" in p.read_text() or "from ..llm" in p.read_text() for p in others)
