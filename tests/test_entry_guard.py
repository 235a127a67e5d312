"""The entry works where the training-data subpackage, the pipeline or a library they need is missing."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = """
import sys
for name in {missing!r}:
    sys.modules[name] = None  # importing it raises ImportError
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
names = set(e.queries())
assert set(e.oracle_sql()) <= names and "retention_interval" in names
print(any(n.startswith("op") and n[2].isdigit() for n in names), "pipeline" in names)
"""


@pytest.mark.parametrize("missing", [
    ("cohortscope.llm",), ("cohortscope.llm.catalog", "corpus_pipeline"), ("corpus_pipeline",), ("numpy",),
])
def test_queries_without(missing):
    done = subprocess.run([sys.executable, "-c", ASK.format(missing=missing, repo=REPO)],
                          capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    has_ops, has_pipeline = done.stdout.split()
    if missing == ("corpus_pipeline",):
        assert has_pipeline == "False"
    else:
        assert (has_ops, has_pipeline) == ("False", "False")
