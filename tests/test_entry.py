import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return None if v is None else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    cursor = c.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr([plain(v) for _, v in sorted(zip(names, r, strict=True))]) for r in cursor.fetchall())
    df = catalog.queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr([plain(v) for v in r]) for r in df.select(*sorted(df.columns)).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("left_out", [["llm"], ["llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_works_without_the_optional_modules(tmp_path, left_out):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(*left_out, ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env=env, check=True, timeout=120)
