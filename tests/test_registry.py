"""Each registered query of the engine against its SQL on the smallest tables, and the driver contract without the pipeline subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from corvane.plans import registry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF)
    if name not in registry.oracle_sql():
        assert got.count() > 0
        return
    rows = got.toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()
    assert sorted(rows.columns) == sorted(want.columns)
    norm = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False, name=None)))
    assert norm(rows) == norm(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_pipeline_subpackage(tmp_path):
    shutil.copytree(ROOT / "corvane", tmp_path / "corvane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_search' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_with_a_broken_pipeline_subpackage(tmp_path):
    """What is left of the folder, or a dependency that is missing, takes no other query along."""
    shutil.copytree(ROOT / "corvane", tmp_path / "corvane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corvane" / "llm" / "__pycache__").mkdir(parents=True)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_dependency\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_search' in q and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_payload_of_pages_without_title(spark, tmp_path):
    rows = [(1, "\nbody", "s"), (2, None, "s"), (3, "T\nx", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' as lang", "1L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.page_id: r for r in registry.queries()["payload"](spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].breadcrumb == "s" and got["3"].breadcrumb == "s > T"
