"""The entry point with and without the optional training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def _queries(folder: Path) -> set[str]:
    return set(subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True).stdout.split())


def test_rest_imports_without_the_subpackage(tmp_path):
    """A copy without the folder, with and without the pipeline module, still has every core query."""
    for name in ("vulnlake", "checks"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    bare = _queries(tmp_path)
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        assert _queries(tmp_path) == bare
    from checks import catalog

    assert bare == set(catalog.QUERIES)
