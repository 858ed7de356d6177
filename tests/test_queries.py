"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from auditmill.bindings.registry import QUERIES
from tools import check_queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not there")


@pytest.fixture(scope="module")
def db():
    return check_queries.connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    assert name in entry.oracle_sql()
    assert check_queries.compare(spark, db, FOLDER, name) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["chunk_id", "id", "sim", "rank"] and not df.isEmpty()


# Plans that would not hold at scale, and columns a scan must not read.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition")
WHOLE_TABLE_ROWS = {"severity_summary", "stage_funnel", "audit_funnel", "report_blocks", "id_dictionary"}


@pytest.mark.parametrize("name", sorted(set(QUERIES)))
def test_plan(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in FORBIDDEN:
        # A grand total ends in one task, which gets one row from each task before it.
        if word == "SinglePartition" and name in WHOLE_TABLE_ROWS:
            continue
        assert word not in plan, f"{word} in the plan of {name}"


def test_scans_read_only_what_they_need(spark):
    plan = entry.queries()["known_ids"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint>" in plan
    assert "PushedFilters: [IsNotNull(p_size), LessThan(p_size,10)" in plan
    plan = entry.queries()["retry_findings"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:" in plan and "props" not in plan


def test_replies_are_parsed_once(spark):
    plan = entry.queries()["reply_items"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(cwe_id") == 1
