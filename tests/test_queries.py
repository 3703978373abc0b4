"""Every registered query against its SQL on the smallest scale directory."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from checks.run import TABLES, cells

SF = "/root/testdata/sf0.001"
#: The corpus queries have tests of their own.
CORPUS = re.compile(r"op\d+_|pipeline$")
QUERIES = {k: v for k, v in entry.queries().items() if not CORPUS.match(k)}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if not CORPUS.match(k)}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_flagship(spark):
    assert entry.entry(spark).columns[0] == "final_hits"


def test_only_model_dependent_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {
        "S21_factor_model_store", "I7_implicit_als_fit",
        "I8_implicit_als_predict", "C15_inference_ranker_rows", "R10_feature_binning",
        "R10_bin_borders", "R11_pointwise_ranker_fit", "R12_pointwise_ranker_predict",
        "R13_tree_prefix_curve", "R14_truncated_ranker", "R15_feature_importance",
        "R16_group_ranker", "E21_epsilon_choice", "E22_staged_sweep",
    }


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    mine = cells([tuple(row) for row in df.collect()], df.columns)
    if name not in ORACLES:
        assert mine
        return
    result = db.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(df.columns)
    assert mine == cells(result.fetchall(), names)
