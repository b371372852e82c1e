"""The entry gives the library's own queries where the llm folders, or a library of theirs, are absent."""

import subprocess
import sys

import pytest

from conftest import ROOT

BLOCKED = """
import sys, warnings
warnings.simplefilter("ignore")
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {0!r} or name.startswith({0!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as E
print(len(E.queries()), len(E.oracle_sql()), "pipeline" in E.queries())
"""


@pytest.mark.parametrize("module", ["ahocorasick", "zstandard", "daygrain.llm", "corpus_pipeline"])
def test_entry_without(module):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(module)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, sql, pipeline = done.stdout.split()
    assert int(n) >= 60 and int(sql) >= 50 and pipeline == "False"


def test_entry_raises_for_a_fault_of_the_rest():
    done = subprocess.run([sys.executable, "-c", BLOCKED.format("daygrain.session")], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "daygrain.session" in done.stderr
