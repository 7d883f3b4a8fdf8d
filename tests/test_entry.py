"""The entry must work whatever of the optional part can be imported."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in q))"


@pytest.mark.parametrize("missing", ["xxhash", "sentencepiece", "corpus_pipeline", "harborline.llm", "harborline.llm.queries"])
def test_entry_without_the_optional_part(missing):
    block = f"import sys; sys.modules[{missing!r}] = None; "
    run = subprocess.run([sys.executable, "-c", block + SHOW], cwd=ROOT, capture_output=True, text=True, timeout=100, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert run.returncode == 0, run.stderr
    queries, twins, corpus = run.stdout.split()
    assert int(queries) >= 98 and int(twins) >= 94 and corpus == "False"
