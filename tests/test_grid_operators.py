import datetime as dt

import pytest
from pyspark.sql import functions as F

from steward.operators import keys as ky, normalize as nz, profile as pf
from steward.sources.grid import melt_to_cells
from tests.support import Error, Formula, grid, rows, structure

OPTIONS = pf.InspectionOptions(50, 20)
PLAIN = [
    ["TEST-HEADER-A", "TEST-HEADER-B", "TEST-HEADER-C", None],
    ["TEST-CELL-VALUE", 42, True, dt.datetime(2020, 1, 1)],
    ["TEST-CELL-2", 3.14, None, None],
]


def codes(findings):
    return sorted(r.code for r in findings.collect())


def test_plain_sheet(spark):
    p = pf.sheet_profile(grid(spark, PLAIN), structure(spark), OPTIONS).head()
    assert (p.non_empty_cell_count, p.string_count, p.number_count) == (9, 5, 2)
    assert (p.boolean_count, p.date_count, p.blank_count, p.formula_count) == (1, 1, 3, 0)
    assert (p.inferred_header_row, p.header_confidence) == (1, "high")
    headers = pf.infer_header(grid(spark, PLAIN), structure(spark))
    assert pf.header_candidates(grid(spark, PLAIN), headers).count() == 3


def test_profile_never_carries_text(spark):
    p = pf.sheet_profile(grid(spark, PLAIN), structure(spark, sheet_name="TEST-SECRET"), OPTIONS)
    assert "TEST-" not in str(p.collect())


@pytest.mark.parametrize(
    ("cells", "changes", "expected"),
    [
        ([["A", "B"], [1, Formula("=SUM(1,2)")]], {}, []),
        ([[7], [], [None, None, "text"], [], [None, 9]], {}, ["WORKBOOK_HEADER_NOT_DETECTED"]),
        ([["H", " H ", "H"], [1, 2, 3]], {}, ["WORKBOOK_DUPLICATE_HEADER_DIGEST"]),
        ([["A", None, "C"], [1, 2, 3]], {"merged_top_rows": 1, "merged_range_count": 1},
         ["WORKBOOK_MERGED_HEADER_REGION"]),
        ([["A", "B"], [1, Error("#N/A")]], {}, ["WORKBOOK_CELL_ERROR_PRESENT"]),
        ([[None, None]], {"declared_rows": 0}, ["WORKBOOK_EMPTY_SHEET"]),
        ([[None, None]], {"drawing_count": 1}, ["WORKBOOK_DRAWING_ONLY_SHEET"]),
        ([[None, None]], {"table_count": 1}, ["WORKBOOK_HEADER_NOT_DETECTED"]),
        ([[None]] * 5, {"declared_rows": 60},
         ["WORKBOOK_HEADER_NOT_DETECTED", "WORKBOOK_SCAN_LIMIT_REACHED"]),
        ([["A", "B"], [1, 2]], {"declared_rows": 501},
         ["WORKBOOK_DECLARED_DIMENSION_EXCESSIVE", "WORKBOOK_SCAN_LIMIT_REACHED"]),
    ],
)
def test_sheet_findings(spark, cells, changes, expected):
    profile = pf.sheet_profile(grid(spark, cells), structure(spark, **changes), OPTIONS)
    assert codes(pf.sheet_findings(profile, OPTIONS)) == expected


@pytest.mark.parametrize(
    ("cells", "row", "confidence"),
    [
        ([["A", "B", "C", 1, 2], [1, 2, 3, 4, 5]], 1, "medium"),
        ([["A", 1, 2], ["B", "C"], [1]], 2, "high"),
        ([["A", "B"]], 1, "medium"),  # last scanned row
        ([[1, 2]] * 10 + [["A", "B"], [1, 2]], None, "none"),  # beyond the search depth
        ([[1, 2]] * 9 + [["A", "B"], [1, 2]], 10, "high"),
        ([[1, 2]] * 9 + [["A", "B"]], 10, "medium"),
    ],
)
def test_header_rules(spark, cells, row, confidence):
    got = pf.infer_header(grid(spark, cells), structure(spark)).head()
    assert (got.inferred_header_row, got.header_confidence) == (row, confidence)


def test_scan_budget_must_be_positive():
    with pytest.raises(ValueError, match="INVALID_INSPECTION_OPTION"):
        pf.InspectionOptions(0, 5)


def test_container_findings(spark):
    def part(name, text=None, flags=0):
        return ("W", name, 10, 100, flags, text)

    good = [part("[Content_Types].xml", "<Types/>"), part("xl/workbook.xml")]
    ddl = ("workbook_id string, entry_name string, compress_size bigint, file_size bigint, "
           "flag_bits int, text string")
    cases = [
        (good, []),
        (good[:1], ["XLSX_REQUIRED_PART_MISSING"]),
        (good + [part("../x")], ["XLSX_PATH_TRAVERSAL_ENTRY"]),
        (good + [part("C:x")], ["XLSX_PATH_TRAVERSAL_ENTRY"]),
        (good + [part("a"), part("a")], ["XLSX_DUPLICATE_ENTRY"]),
        (good + [part("a", flags=1)], ["XLSX_ENCRYPTED_ENTRY"]),
        (good + [part("xl/vbaProject.bin")], ["WORKBOOK_MACRO_DETECTED"]),
        (good + [part("customXml/item1.xml")], ["WORKBOOK_CUSTOM_XML_PRESENT"]),
        (good + [part("xl/_rels/workbook.xml.rels", 'Type="http://x/externalLink"')],
         ["WORKBOOK_EXTERNAL_LINK_DETECTED"]),
    ]
    for parts, expected in cases:
        found = pf.container_findings(spark.createDataFrame(parts, ddl), OPTIONS)
        assert codes(found) == expected
    profile = pf.container_profile(spark.createDataFrame(good, ddl)).head()
    assert profile.compression_ratio == 10.0


SPEC = nz.MappingSpec(
    "TEST-DATASET-001", 0, 1, 2,
    (
        nz.MappedColumn(1, "test_identifier", True, "string"),
        nz.MappedColumn(2, "test_name", True, "string"),
        nz.MappedColumn(3, "test_number", False, "number"),
    ),
)
TABLE = [
    ["A", "B", "C"], ["TEST-ID-001", "TEST-NAME-001", 10], ["TEST-ID-002", None, Formula("=A1")],
    [None, None, None], ["TEST-ID-003", " TEST-NAME-003 ", None], ["   ", "x", 1],
]


def test_normalize(spark):
    cells = grid(spark, TABLE)
    mapped = nz.map_columns(cells, SPEC)
    assert rows(nz.reject_rows(mapped, SPEC), "code", "path") == [
        ("FORMULA_VALUE_PROHIBITED", "$.sheets.0.rows.3.columns.3"),
        ("REQUIRED_VALUE_MISSING", "$.sheets.0.rows.3.columns.2"),
        ("REQUIRED_VALUE_MISSING", "$.sheets.0.rows.6.columns.1"),
    ]
    records = nz.normalized_records(cells, SPEC)
    assert rows(records, "record_ordinal", "source_row_ordinal", "values.test_name") == [
        (0, 2, "TEST-NAME-001"), (1, 5, "TEST-NAME-003"),
    ]
    summary = nz.normalization_summary(mapped, SPEC).head()
    assert (summary.source_record_count, summary.normalized_record_count) == (4, 2)
    assert (summary.rejected_record_count, summary.finding_count) == (2, 3)
    evidence = rows(nz.mapping_evidence(mapped, SPEC), "target_field", "mapped_record_count",
                    "rejected_record_count")
    assert evidence == [("test_identifier", 2, 1), ("test_name", 2, 1), ("test_number", 1, 1)]


def test_cleared_sheet_without_rows_keeps_evidence_and_summary(spark):
    cleared = spark.createDataFrame(
        [("WB", 0, "SRC"), ("NONE", 0, "SRC-2")], "workbook_id string, sheet_ordinal int, source_id string"
    )
    out = nz.normalize(grid(spark, TABLE), SPEC, cleared)
    assert rows(out.summary, "workbook_id", "source_record_count") == [("NONE", 0), ("WB", 4)]
    assert out.evidence.count() == 6
    assert {r.source_id for r in out.records.collect()} == {"SRC"}
    unauthorized = nz.normalize(grid(spark, TABLE), SPEC, cleared.filter("workbook_id = 'NONE'"))
    assert unauthorized.records.count() == 0 and unauthorized.findings.count() == 0


@pytest.mark.parametrize(
    "change",
    [dict(first_data_row=1), dict(columns=()), dict(columns=(SPEC.columns[0],) * 2), dict(header_row=0),
     dict(columns=(nz.MappedColumn(1, "a", True, "text"),))],
)
def test_bad_mapping_specs(change):
    with pytest.raises(ValueError, match="MAPPING_SPEC_INVALID"):
        nz.MappingSpec(**{**SPEC.__dict__, **change})


@pytest.mark.parametrize("partitions", [1, 7])
def test_record_ordinals_cross_buckets(spark, partitions):
    """One hot sheet over many buckets numbers like a single sort would."""
    table = [["A", "B", "C"]] + [
        [f"id{i}", None if i % 5 == 0 else "n", i] for i in range(200)
    ]
    cells = grid(spark, table).repartition(partitions)
    got = nz.record_ordinal(cells, SPEC, bucket_width=16)
    kept = [i + 2 for i in range(200) if i % 5]
    assert rows(got, "record_ordinal", "row_ordinal") == list(enumerate(kept))


def test_number_rows_and_first_rows(spark):
    df = spark.range(1000).selectExpr(
        "IF(id % 3 = 0, 'hot', 'g' || id % 7) AS g", "id * 5 AS at", "id % 4 AS k"
    )
    numbered = ky.number_rows(df, ["g"], "at", "n", width=64)
    for group, part in numbered.toPandas().groupby("g"):
        part = part.sort_values("at")
        assert list(part["n"]) == list(range(len(part))), group
    firsts, later = ky.split_first(df, ["g", "k"], "at")
    assert firsts.count() + later.count() == 1000
    assert firsts.count() == df.select("g", "k").distinct().count()
    assert rows(ky.first_per_key(df, ["g", "k"], "at"), *df.columns) == rows(firsts, *df.columns)


def test_melt_keeps_types_and_blanks(spark):
    df = spark.createDataFrame(
        [("W", 0, 2, "x", 1, True, dt.datetime(2020, 1, 2)), ("W", 0, 3, None, None, None, None)],
        "workbook_id string, sheet_ordinal int, row_ordinal bigint, s string, n int, b boolean, d timestamp",
    )
    cells = melt_to_cells(df, ["s", "n", "b", "d"])
    assert rows(cells, "row_ordinal", "column_ordinal", "cell_type") == [
        (2, 1, "string"), (2, 2, "number"), (2, 3, "boolean"), (2, 4, "date"),
        (3, 1, "blank"), (3, 2, "blank"), (3, 3, "blank"), (3, 4, "blank"),
    ]


def test_cell_rules_run_on_a_stream(spark, tmp_path):
    """Classification and typing are pure columns, so a stream of cells takes them too."""
    source, sink = str(tmp_path / "cells"), str(tmp_path / "out")
    cells = grid(spark, TABLE)
    cells.write.parquet(source)
    stream = spark.readStream.schema(cells.schema).parquet(source)
    typed = nz.mapped_cells(stream, SPEC).filter(F.col("cell_type") == "formula")
    query = typed.writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "ck")
    ).trigger(availableNow=True).start(sink)
    query.awaitTermination(60)
    assert spark.read.parquet(sink).count() == 1
