"""Every registered query against its DuckDB SQL on the smallest tables; the entry point; the absence of the llm folders."""

import glob
import os
import subprocess
import sys

import __spark_entry__ as entry
import duckdb
import pytest

DIR = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, db, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rel = db.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    assert plain(df.select(*[f"`{c}`" for c in cols]).collect()) == plain([[r[rel.columns.index(c)] for c in cols] for r in rel.fetchall()])


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in ORACLE and not n.startswith("op") and n != "pipeline"))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_import_without_llm(tmp_path):
    for name in os.listdir(root := os.path.dirname(os.path.abspath(entry.__file__))):
        if name not in ("corpus_pipeline.py", "ledgerfold", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "ledgerfold")
    for name in os.listdir(f"{root}/ledgerfold"):
        if name != "llm":
            os.symlink(f"{root}/ledgerfold/{name}", tmp_path / "ledgerfold" / name)
    code = "import __spark_entry__ as e; n = list(e.queries()); assert n and not any(x.startswith('op') or x == 'pipeline' for x in n) and e.oracle_sql()"
    os.unlink(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(entry.__file__).read())
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
