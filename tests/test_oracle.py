"""Every registered query at the smallest scale: same answer as its SQL twin, and a plan that scales."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
FORBIDDEN = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|PythonUDF")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_answer(spark, con, name):
    plans = []

    def build(session, sf_dir):
        df = contract.queries()[name](session, sf_dir)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    problems = compare(spark, con, build, contract.oracle_sql()[name], SF)
    assert not problems, "\n".join(problems)
    found = FORBIDDEN.search(plans[0])
    assert not found, f"{found.group(0)} in the plan"


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_runs_without_twin(spark, name):
    df = contract.queries()[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_twins_are_registered_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
