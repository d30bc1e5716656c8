"""What is left where the training-data operators' files or libraries aren't there."""

import subprocess
import sys

import pytest

CODE = """
import sys, warnings
for name in sys.argv[1].split(","):
    sys.modules[name] = None  # as if it weren't installed
warnings.simplefilter("error" if sys.argv[1] == "none" else "always")
import __spark_entry__ as e
print(len([q for q in e.queries() if not q.startswith("op") and q != "pipeline"]), sum(q.startswith("op") and q[2].isdigit() for q in e.queries()), "pipeline" in e.queries())
"""


@pytest.mark.parametrize("hidden", ["ahocorasick", "gleaner.llm", "corpus_pipeline"])
def test_the_other_queries_load(hidden):
    from gleaner import catalog

    run = subprocess.run([sys.executable, "-c", CODE, hidden], capture_output=True, text=True, check=True)
    assert run.stdout.split() == [str(len(catalog.QUERIES)), "0", "False"]
    assert hidden in run.stderr and "left out" in run.stderr
