"""Every SQL-backed query against DuckDB on the smallest tables: values, types, and the shape of the plan."""

import re

import pytest
from conftest import SF_DIR
from oracle_check import compare, duck

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


# Files, streams and models run eager steps or Python on purpose; everything else must stay in SQL plans.
EAGER = re.compile(r"(str|ml1[36]|snk|pip5|pip6|src)")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, con):
    held = []

    def once(session, sf_dir):
        held.append(QUERIES[name](session, sf_dir))
        return held[0]

    note, ok = compare(name, spark, con, SF_DIR, once, ORACLES[name])
    assert ok, note
    if not EAGER.match(name):
        plan = held[0]._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|PythonEval|InPandas", plan)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
