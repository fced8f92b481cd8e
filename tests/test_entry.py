"""The entry's queries without the optional training-data package, or where something that it needs can't be imported."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
q = e.queries()
print(len([n for n in q if not n.startswith("op") and n != "pipeline"]), "pipeline" in q, set(e.oracle_sql()) <= set(q))
"""


@pytest.mark.parametrize("names", [("scintlake.llm", "corpus_pipeline"), ("public_tokenizers",), ("corpus_pipeline",)])
def test_other_queries_stay(names):
    out = subprocess.run([sys.executable, "-c", BLOCK.format(names=names)], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 100 and out[1:] == ["False", "True"]
