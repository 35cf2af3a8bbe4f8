"""The entry module with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()), 'pipeline' in E.queries())"


@pytest.mark.parametrize("gone", [["ebbtide/llm"], ["corpus_pipeline.py"], ["ebbtide/llm", "corpus_pipeline.py"]])
def test_registry_without_the_optional_parts(tmp_path, gone):
    for p in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / p).exists():
            shutil.copy(REPO / p, tmp_path / p)
    shutil.copytree(REPO / "ebbtide", tmp_path / "ebbtide", ignore=shutil.ignore_patterns("__pycache__", *[Path(g).name for g in gone]))
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True) if "corpus_pipeline.py" in gone else None
    done = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, oracles, pipeline = done.stdout.split()
    from ebbtide import registry
    registry.load_all()
    assert int(n) >= len(registry.QUERIES) and int(oracles) >= len(registry.ORACLE) and pipeline == "False"
