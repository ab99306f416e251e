"""What keeps memory and work of the heavier steps in line with their input."""

import io
import re

from steward.operators import authorize as az
from steward.plans.byte_documents import _packed
from steward.session import BATCH_BYTES
from steward.sources import workbooks as wb
from steward.sources.authorization_documents import read_authorization_documents


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sheets(spark, *keys):
    return spark.createDataFrame(list(keys), "authorization_id string, sheet_ordinal int")


def test_key_set_difference_groups_both_sides_once(spark):
    got = az.key_set_difference(sheets(spark, ("A", 1), ("A", 1), ("A", 2), ("A", -1), (None, 3), ("A", None)),
                                sheets(spark, ("A", 2), ("A", 5), ("A", 5), ("A", None), (None, 3), (None, 4)))
    assert physical(got).count("Exchange hashpartitioning") == 1
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        ("A", 1, "authorization"), ("A", 5, "report"), ("A", None, "report"), (None, 4, "report")]))


def test_finding_ledger_shuffles_before_it_groups(spark):
    findings = spark.createDataFrame([("A", 1, "WARNING", "X", "$.sheets.0"), ("A", 2, "ERROR", "X", "$.sheets.0")],
                                     "authorization_id string, finding_index bigint, severity string, code string, path string")
    acks = spark.createDataFrame([("A", "X", 0, "resolved"), ("A", "Y", None, "resolved")],
                                 "authorization_id string, code string, sheet_ordinal int, disposition string")
    ledger = az.finding_ledger(findings, acks)
    plan = physical(ledger)
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert "HashAggregate" not in plan.split("Exchange")[1]
    assert {tuple(r) for r in ledger.collect()} == {("A", "X", 0, 3, 1, 2), ("A", "Y", None, None, 1, 0)}


def test_occurrences_are_counted_without_building_findings(spark):
    counted = az._occurrences([az._rule("x > 1", "A", "$", "x"), az._rule("x > 2", "B", "$"), az._rule("x IS NULL AND x > 0", "C", "$")])
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "x int").select("x", counted.alias("n"))
    assert dict(map(tuple, df.collect())) == {1: 0, 2: 2, 3: 4, None: 0}
    assert "named_struct" not in physical(df) and "aggregate" not in physical(df)


def test_a_list_of_a_document_is_read_alone(spark):
    docs = spark.createDataFrame([("A", '{"version":1,"sheets":[{"sheetOrdinal":2}]}', '{"findings":[]}', "{}", "/o")],
                                 "authorization_id string, authorization string, report string, binding string, output_dir string")
    read = read_authorization_documents(docs)
    assert [r["sheet_ordinal"] for r in read.auth_sheets.collect()] == [2]
    schema = re.search(r"ReadSchema: (.*)", read.auth_sheets._jdf.queryExecution().executedPlan().treeString()).group(1)
    assert "sheets" in schema and "map<" not in schema



def test_scanners_bound_their_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    try:
        files = spark.createDataFrame([(str(i), bytearray(_packed("<worksheet/>"))) for i in range(7)], "workbook_id string, content binary")
        parts, _ = wb.scan_workbook_parts(files)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == BATCH_BYTES
        assert parts.count() == 35
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_cells_of_a_row_are_no_events():
    sheet = b'<worksheet><sheetData><row r="1"><c r="A1"><v>1</v></c><c r="B1"><v>2</v></c></row></sheetData></worksheet>'
    assert [(event, tag) for event, tag, _ in wb.events_of(io.BytesIO(sheet))] == [("start", "row"), ("end", "row")]
