"""The driver's correctness gate, run locally: every registered query with
an oracle must match DuckDB at sf0.01; the others must run."""

import os

import pytest

import __spark_entry__ as E
from tests.oracle_harness import compare, duck

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
SLOW = {"drivers", "drivers_top", "train_regression", "train_classification", "kmeans"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in E.queries() if n in E.oracle_sql()])
def test_matches_oracle(spark, con, name):
    res = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF, con)
    assert res["ok"], res


@pytest.mark.parametrize("name", [n for n in E.queries() if n not in E.oracle_sql() and n not in SLOW])
def test_runs_without_oracle(spark, name):
    assert E.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["l_returnflag", "l_linestatus"]
