"""Every registered query against its SQL twin on the smallest tables, and what its plan may hold."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from steward.plans.bindings import TABLES
from tools.check_oracle import plain

SF = os.environ.get("STEWARD_TEST_SF", "/root/testdata/sf0.001")
#: The training-data operators have their own tests.
QUERIES, ORACLE = ({k: v for k, v in part.items() if k not in entry.LLM_QUERIES}
                   for part in (entry.queries(), entry.oracle_sql()))
#: Queries whose inputs are byte documents parsed or built in Python.
PYTHON = {"scan_manifests", "scan_manifest_findings", "scan_workbook_parts", "sheet_structure"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = plain(df.toArrow())
    want = plain(db.sql(ORACLE[name]).to_arrow_table())
    assert got[:2] == want[:2]
    assert got[2] == want[2]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "NestedLoopJoin" not in physical
    assert "ScalarSubquery" not in plan
    assert ("MapInPandas" in physical) == (name in PYTHON)
    assert not re.search("BatchEvalPython|ArrowEvalPython", physical)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(df):
    """Names of the columns that each hash exchange of a plan moves."""
    found, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "Exchange" and "hashpartitioning" in node.outputPartitioning().toString():
            output = node.output()
            found.append([output.apply(i).name() for i in range(output.size())])
    return found


@pytest.mark.parametrize("name, most", [
    ("drop_blank_rows", 0), ("map_columns", 0), ("reject_rows", 0), ("mapping_evidence", 1), ("normalization_summary", 1),
    ("blank_row_count", 1),
])
def test_grid_rows_are_not_shuffled(spark, name, most):
    df = QUERIES[name](spark, SF)
    assert len(exchanged(df)) <= most
    assert "SortAggregate" not in physical(df) and "ObjectHashAggregate" not in physical(df)


@pytest.mark.parametrize("name", ["normalized_records", "record_ordinal"])
def test_only_typed_records_are_shuffled_for_numbering(spark, name):
    moved = exchanged(QUERIES[name](spark, SF))
    assert moved and not any(c in ("cells", "cell", "cell_type", "value_string") or c.startswith("_cell_") for names in moved for c in names)


@pytest.mark.parametrize("name, scans", [("sheet_profile", 5), ("inspection_gate", 6), ("workbook_rollup", 6), ("finding_counts", 6), ("inspection_summary", 6)])
def test_profiles_read_the_grid_once(spark, name, scans):
    plan = physical(QUERIES[name](spark, SF))
    assert plan.count("FileScan parquet") <= scans and "SortAggregate" not in plan


@pytest.mark.parametrize("name, scans", [("verify_manifest", 4), ("manifest_state", 5), ("report_finding_keys", 4), ("authorization_gate", 8)])
def test_entries_and_findings_are_read_few_times(spark, name, scans):
    assert physical(QUERIES[name](spark, SF)).count("FileScan parquet") <= scans
