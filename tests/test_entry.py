"""The driver's contract, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and "redaction_report" in q
    assert e.entry(spark).count() > 0


def test_without_llm(tmp_path):
    to = tmp_path / "repo"
    to.mkdir()
    shutil.copytree(ROOT / "larkspur", to / "larkspur", ignore=lambda d, names: ["llm", "__pycache__"])
    shutil.copy(ROOT / "__spark_entry__.py", to)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'redaction_report' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(to)})
