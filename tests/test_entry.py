"""The entry without the training-data folders, as a copy of the repository that lacks them."""

from __future__ import annotations

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_import_without_llm(tmp_path, pipeline):
    for name in ("__spark_entry__.py", "bench.py") + (("corpus_pipeline.py",) if pipeline and (ROOT / "corpus_pipeline.py").exists() else ()):
        shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "corvane", tmp_path / "corvane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rrf_fusion' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
