"""Queries against their SQL on the smallest data, like the driver does on larger data."""

import re

import pytest

import __spark_entry__ as contract
from check import differences, oracle_connection

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"gbt_fit", "forest_fit", "run_regression", "regression_sweep", "predict_unseen"}
OPTIONAL = re.compile(r"op\d+_\w+|pipeline")  # of the optional part, which has its own tests


def core(names):
    return {n for n in names if not OPTIONAL.fullmatch(n)}


def test_only_model_queries_have_no_sql():
    assert core(contract.queries()) - core(contract.oracle_sql()) == ROWS_ONLY
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(core(contract.oracle_sql())))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert differences(got, duck.execute(contract.oracle_sql()[name]).df(), 2e-6) == []


def test_entry(spark):
    assert contract.entry(spark).count() == 12
