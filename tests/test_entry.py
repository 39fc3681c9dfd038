"""Registered queries against their SQL on the smallest tables, and the guard around the optional subpackage."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from cascata.plans.registry import ORACLES, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [k for k in ORACLES if k not in {"saved_nodes_by_strategy", "rr_influence_lt", "lt_spread", "rr_worst_case", "all_greedy", "single_greedy", "truncated_sum", "worst_case_objective", "robust_sequence_relational", "bottleneck_pairs"}]


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    fix = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else (f"{v:.6f}" if isinstance(v, float) else str(v))
    return sorted((tuple(fix(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = QUERIES[name](spark, sf_dir)
    sql = db.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(sql.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(sql.columns, sql.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["l", "sum_max_reach", "avg_max_reach"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_optional_subpackage():
    code = "import sys; sys.modules['cascata.llm'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
