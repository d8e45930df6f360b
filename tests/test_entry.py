import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from logforge.plans import queries as dumps

#: Run in a process of its own: the training-data subpackage cannot be imported.
WITHOUT = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("logforge.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(k[2:3].isdigit() or k == "pipeline" for k in e.queries()))
"""


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_subpackage():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    out = subprocess.run([sys.executable, "-c", WITHOUT], cwd=root, capture_output=True, text=True, timeout=120)
    queries, oracles, more = out.stdout.split()
    assert int(queries) == int(oracles) == len(dumps.QUERIES) and more == "False", out.stderr


def test_flagship(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    assert entry.entry(spark).count() == 1
