import functools
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tiepoint import queries
from tiepoint.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem part".split()
STREAMS = {"stream_ledger", "stream_layer", "stream_retries", "stream_retried_layer"}  # in test_streaming


def shown(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda v: repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(cell(r[k]) for k in order) for r in found)


@pytest.fixture(scope="module", autouse=True)
def merged_once():
    """Queries over the same merge, preview or rollback share it here: all of them read stored tables."""
    with pytest.MonkeyPatch.context() as patch:
        for name in ("_preview", "_applied", "_copying", "_rolled_back", "_stored", "_written"):
            patch.setattr(queries, name, functools.cache(getattr(queries, name)))
        yield


@pytest.mark.parametrize("name", sorted(set(ORACLES) - STREAMS))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, SF), db.sql(ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert shown(ours.columns, ours.collect()) == shown(theirs.columns, theirs.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["cap_oid", "auth_oid", "distance_m"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_does_without_the_corpus_operators():
    """Every other module and the entry work where the subpackage, its tokenizers and the pipeline are missing."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    names = [
        os.path.relpath(os.path.join(folder, n), root)[:-3].replace(os.sep, ".")
        for folder, _, files in os.walk(os.path.join(root, "tiepoint")) for n in files if n.endswith(".py") and os.path.basename(folder) != "llm"
    ]
    code = f"""
import sys, importlib
class Blocked:
    def find_spec(self, name, *_):
        if name.split(".")[:2] == ["tiepoint", "llm"] or name in ("corpus_pipeline", "public_tokenizers", "tokenizers"):
            raise ModuleNotFoundError(name, name=".".join(name.split(".")[:2]))
sys.meta_path.insert(0, Blocked())
for name in {names!r}:
    importlib.import_module(name.removesuffix(".__init__"))
import __spark_entry__
assert len(__spark_entry__.queries()) == {len(QUERIES)}, sorted(__spark_entry__.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
