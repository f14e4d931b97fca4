"""Every query with a statement against DuckDB over the smallest tables, and the contract of the entry file."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from plumbline.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__module__ == "decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_statement(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) ))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_contamination_queries_find_whole_passages(spark, tmp_path):
    item = [f"w{i}" for i in range(100)]
    spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "nothing of it"), (2, " ".join(["a", *item[5:95], "b"])), (3, " ".join(item))]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.name: (r.longest_match, r.capped) for r in QUERIES["longest_match"](spark, str(tmp_path)).collect()}
    assert found == {1: (0, False), 2: (90, False), 3: (100, False)}
    report = {r.name: r.longest_match for r in QUERIES["contamination_report"](spark, str(tmp_path)).collect()}
    assert report["7"] == 100


def test_entry_file_without_the_subpackage(tmp_path):
    """The entry file imports and lists the other queries where the subpackage for training data is gone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "plumbline"):
        os.symlink(f"{root}/{name}", tmp_path / name) if name.endswith(".py") else _copy(f"{root}/{name}", tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'attrition_plan' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_entry_file_does_not_hide_a_broken_operator(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    _copy(f"{root}/plumbline", tmp_path / "plumbline")
    (tmp_path / "plumbline" / "llm").mkdir()
    (tmp_path / "plumbline" / "llm" / "__init__.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_here\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode and "no_such_module_here" in done.stderr


def _copy(source, target):
    import shutil

    shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
