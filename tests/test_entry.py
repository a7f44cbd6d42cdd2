import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_module
from docquarry.plans.queries import QUERIES, SQL  # the entry module has added those of ``more``

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return str(v.replace(tzinfo=None)) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() == 20


@pytest.mark.parametrize("name", [n for n in QUERIES])
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in SQL:
        got = duck.execute(SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in got.fetchall())


def test_works_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(root):
        if name not in ("docquarry", "corpus_pipeline.py", "tests") and not name.startswith("."):
            (tmp_path / name).symlink_to(f"{root}/{name}")
    (tmp_path / "docquarry").mkdir()
    for name in os.listdir(f"{root}/docquarry"):
        if name != "llm":
            (tmp_path / "docquarry" / name).symlink_to(f"{root}/docquarry/{name}")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'vector_topk' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
