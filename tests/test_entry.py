import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _value(x):
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    return round(x, 9) if isinstance(x, float) and x != int(x) else int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["pattern_count", "pattern_range", "suffix_array", "lcp_array", "tree_parent", "tree_suffix_link", "maximal_matches", "left_right_matches", "rlz_decode", "rmq_leftmost"])
def test_same_rows_as_sql(spark, name):
    sql = duckdb.connect()
    for t in TABLES:
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    expected = sql.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    rows = lambda df: sorted(str([_value(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(expected)


def test_rest_stands_without_llm(tmp_path):
    """The library and its entry import where the optional subpackage is gone."""
    for name in ("stringloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "stringloom/llm")], check=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
