"""The library without the corpus operators: their folders and the pipeline are deleted on some machines."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PRINT = "import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline", [False, True])
def test_queries_without_the_corpus_folders(tmp_path, pipeline):
    gone = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=gone)
    out = subprocess.run([sys.executable, "-B", "-c", PRINT], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    names, oracles = (x.split() for x in out.stdout.strip().splitlines()[-1].split("|"))
    assert len(names) > 50 and set(oracles) <= set(names)
    assert not [n for n in names if n == "pipeline" or n.startswith("op") and n[2].isdigit()]
