"""Every query of the core that SQL can express, against DuckDB on the smallest tables."""

import pytest

from docloom.plans import core_problems, event_queries, graph_queries, pipeline_queries, retrieval_queries, rule_cases, text_queries
from tests.compare import differences, duck

DIR = "/root/testdata/sf0.001"
QUERIES = {n: (f, m.SQL.get(n)) for m in (core_problems, text_queries, retrieval_queries, graph_queries, event_queries, pipeline_queries, rule_cases) for n, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return duck(DIR)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_same_as_sql(spark, con, name):
    query, sql = QUERIES[name]
    same, ours, theirs, _ = differences(spark, con, query, sql, DIR)
    assert same
    assert (ours, theirs) == ([], [])


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_runs(spark, name):
    assert QUERIES[name][0](spark, DIR).count() >= 0


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 90
