import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_training_data_part(tmp_path, pipeline):
    """Without chainlake/llm and tests/llm everything else is there, whether or not the pipeline's file is left."""
    copy = tmp_path / "copy"
    drop = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, copy, ignore=drop)
    (copy / "chainlake/llm/__pycache__").mkdir(parents=True)  # what a deletion may leave
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, complete, others = done.stdout.split()
    assert int(n) >= 95 and complete == "True" and others == "False"
