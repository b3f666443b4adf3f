"""The entry points work in a copy that has no corpus operators, with and without the pipeline's file."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_queries_without_corpus_operators(tmp_path, pipeline_stays):
    gone = {os.path.join(ROOT, "mosaicq", "llm"), os.path.join(ROOT, "tests"), os.path.join(ROOT, ".git")}
    gone |= set() if pipeline_stays else {os.path.join(ROOT, "corpus_pipeline.py")}
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if os.path.join(folder, n) in gone or n == "__pycache__"])
    code = "import __spark_entry__ as e, bench; q, s = e.queries(), e.oracle_sql(); assert 'radius_pairs' in q and set(s) <= set(q) and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert not done.returncode, done.stderr
