import hashlib
import io
import os
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from steward.operators import structure as st
from steward.operators.inspection import inspect_workbooks
from steward.operators.profile import InspectionOptions
from steward.sinks import artifacts
from steward.sinks.artifacts import OutputError, read_artifact, write_artifact_set
from steward.sources.documents import scan_json_objects, scan_manifests
from steward.sources import workbooks as wb
from steward.sources.files import scan_file_digests
from steward.sources.grid import cells_of
from steward.sources.workbooks import scan_workbook_cells, scan_workbook_parts, shows_date
from steward.staging import drop_stages, staged
from tests.support import rows, xlsx

ENTRY = """  - source_id: {id}
    fal_version: FALTEST
    ontology_version: 0.0.0-test
    profile_version: p
    source_file: files/a.bin
    source_hash: "{hash}"
"""


def manifest(spark, *contents):
    data = [(f"M{i}", c if isinstance(c, bytes) else c.encode()) for i, c in enumerate(contents)]
    return spark.createDataFrame(data, "manifest_id string, content binary")


def test_manifest_faults(spark):
    good = "version: 1\nsources:\n" + ENTRY.format(id="A", hash="0" * 64)
    files = manifest(
        spark, good, "version: 1\nversion: 1\n", "version: 1\nsources:\n  - {a: 1, a: 2}\n", "- 1\n",
        "a: [1\n", b"\xff\xfe", "version: true\nsources: 3\n", "version: 1\nsources: [1]\n",
        good + "    status: approved\n", good + "    colour: red\n", "version: 1\nsources: [{source_id: 5}]\n",
    )
    manifests, entries, findings = scan_manifests(files)
    assert rows(findings, "subject_id", "code", "path") == sorted([
        ("M1", "MANIFEST_DUPLICATE_KEY", "$"), ("M2", "MANIFEST_DUPLICATE_KEY", "$"),
        ("M3", "MANIFEST_ROOT_NOT_OBJECT", "$"), ("M4", "MANIFEST_YAML_INVALID", "$.manifestPath"),
        ("M5", "MANIFEST_YAML_INVALID", "$.manifestPath"),
        ("M6", "MANIFEST_CONTRACT_INVALID", "$.version"),
        ("M6", "MANIFEST_CONTRACT_INVALID", "$.sources"),
        ("M7", "MANIFEST_CONTRACT_INVALID", "$.sources.0"),
        ("M9", "MANIFEST_ENTRY_INVALID", "$.sources.0.colour"),
        ("M10", "MANIFEST_ENTRY_INVALID", "$.sources.0.source_id"),
    ])
    assert rows(entries.filter("has_forbidden_field"), "manifest_id") == [("M8",)]
    assert manifests.count() == 11


@pytest.mark.parametrize(
    ("text", "pending"),
    [
        ("standard: {status: pending_source}\nfiles: []\ningestion: {status: pending_source}\n", True),
        ("standard: {status: pending_source}\nfiles: [a]\ningestion: {status: pending_source}\n", False),
        ("standard: {status: done}\nfiles: []\ningestion: {status: pending_source}\n", False),
        ("# pending_source\nfiles: []\n", False),
        ("standard: {status: pending_source}\nfiles: []\ningestion: {status: pending_source}\nx: 1\n", False),
    ],
)
def test_pending_placeholder(spark, text, pending):
    assert scan_manifests(manifest(spark, text))[0].head().pending_shape is pending


def test_file_digests_whole_and_chunked(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    contents = {"a.bin": b"TEST-A", "sub/b.bin": b"x" * 3_000_000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    got = scan_file_digests(spark, str(tmp_path), whole_file_limit=1000)
    assert rows(got, "path", "length", "sha256") == sorted(
        (n, len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()
    )


def test_json_objects(spark):
    docs = spark.createDataFrame([(1, '{"a":1}'), (2, "[]"), (3, None)], "doc_id int, doc string")
    good, bad = scan_json_objects(docs, "authorization")
    assert rows(good, "doc_id") == [(1,)]
    assert rows(bad, "subject_id", "code") == [
        (2, "AUTHORIZATION_JSON_INVALID"), (3, "AUTHORIZATION_JSON_INVALID"),
    ]


SHEET = """<worksheet><dimension ref="A1:D9"/><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>In</t></is></c></row>
<row r="3" hidden="1"><c r="A3"><v>42</v></c><c r="B3" t="b"><v>0</v></c><c r="C3" s="1"><v>43831</v></c><c r="D3"><f>SUM(1,2)</f><v>3</v></c></row>
<row r="4"><c r="A4" t="e"><v>#DIV/0!</v></c><c r="C4" s="2"><v>43831.5</v></c></row>
</sheetData><mergeCells><mergeCell ref="A1:B1"/><mergeCell ref="A11:B11"/></mergeCells><drawing/></worksheet>"""
SHARED = "<sst><si><t>Alpha</t></si><si><r><t>Be</t></r><r><t>ta</t></r><rPh><t>no</t></rPh></si></sst>"
STYLES = (
    '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/></cellXfs></styleSheet>'
)


def books(spark, *contents):
    data = [(f"W{i}", c) for i, c in enumerate(contents)]
    return spark.createDataFrame(data, "workbook_id string, content binary")


def test_workbook_cells(spark):
    cells, failed = scan_workbook_cells(books(spark, xlsx(SHEET, SHARED, styles=STYLES), b"junk"))
    kinds = {(r.row_ordinal, r.column_ordinal): r.cell_type for r in cells.collect()}
    assert len(kinds) == 16  # four rows: trailing declared rows do not exist in the file
    assert [kinds[1, c] for c in (1, 2, 3, 4)] == ["string", "string", "inline_string", "blank"]
    assert {kinds[2, c] for c in (1, 2, 3, 4)} == {"blank"}
    assert [kinds[3, c] for c in (1, 2, 3, 4)] == ["number", "boolean", "date", "formula"]
    assert [kinds[4, c] for c in (1, 2, 3, 4)] == ["error", "blank", "date", "blank"]
    found = cells.filter("value_string = 'Beta'").count()
    assert found == 1
    moments = rows(cells.filter("cell_type = 'date'").select(F.col("value_timestamp").cast("string").alias("t")), "t")
    assert moments == [("2020-01-01 00:00:00",), ("2020-01-01 12:00:00",)]
    assert rows(failed, "subject_id", "code") == [("W1", "WORKBOOK_LOAD_FAILED")]


def test_damaged_workbooks_are_findings_without_cells(spark):
    long = SHEET.replace("</sheetData>", "".join(f'<row r="{i}"><c r="A{i}"><v>{i * 7919 % 10007}</v></c></row>' for i in range(5, 900)) + "</sheetData>")
    good = xlsx(long, SHARED, styles=STYLES)
    spoiled = [bytearray(good) for _ in range(12)]
    for i, book in enumerate(spoiled):
        at = len(good) * (i + 1) // 14
        book[at: at + 8] = bytes(b ^ 0x5A for b in book[at: at + 8])
    encrypted = bytearray(good)
    at = good.index(b"PK\x01\x02")
    while at >= 0:
        encrypted[at + 8] |= 1
        at = good.find(b"PK\x01\x02", at + 4)
    files = books(spark, good, *map(bytes, spoiled), bytes(encrypted), good[: len(good) // 2])
    cells, failed = scan_workbook_cells(files)
    loaded = {r.workbook_id for r in cells.select("workbook_id").distinct().collect()}
    broken = {r.subject_id for r in failed.collect()}
    assert "W0" in loaded and {"W13", "W14"} <= broken and not loaded & broken
    assert loaded | broken == {f"W{i}" for i in range(15)}
    parts, unreadable = scan_workbook_parts(files)
    assert parts.filter("workbook_id = 'W0'").count() > 0 and unreadable.count() > 0


def test_long_integers_of_workbooks_stay_exact(spark):
    sheet = '<worksheet><sheetData><row r="1"><c r="A1"><v>9007199254740993</v></c><c r="B1"><v>12</v></c></row></sheetData></worksheet>'
    cells, _ = scan_workbook_cells(books(spark, xlsx(sheet, SHARED, styles=STYLES)))
    got = [(r.cell_type, r.value_string, r.value_number) for r in cells.orderBy("column_ordinal").collect()]
    assert got == [("number", "9007199254740993", None), ("number", None, 12.0)]


def test_workbook_cells_budget_and_1904(spark):
    book = xlsx(SHEET, SHARED, '<workbookPr date1904="1"/>', STYLES)
    cells, _ = scan_workbook_cells(books(spark, book), max_rows=3, max_columns=3)
    assert cells.count() == 9
    day = cells.filter("cell_type = 'date'").select(F.col("value_timestamp").cast("date").cast("string").alias("d"))
    assert day.head().d == "2024-01-02"


@pytest.mark.parametrize(
    ("fmt", "date"),
    [("yyyy-mm-dd", True), ("[h]:mm", True), ("0.00", False), ('"day" 0', False), ("[Red]0", False),
     ("General", False), ("0;[Red]d", False), ("#,##0\\d", False)],
)
def test_number_formats(fmt, date):
    assert shows_date(fmt) is date


def test_workbook_parts_and_structure(spark):
    parts, bad = scan_workbook_parts(books(spark, xlsx(SHEET, SHARED), b"junk"))
    assert rows(bad, "subject_id", "code") == [("W1", "INVALID_XLSX_CONTAINER")]
    sheet = st.sheet_structure(parts).head()
    assert (sheet.merged_range_count, sheet.merged_top_rows, sheet.hidden_row_count) == (2, 1, 1)
    assert (sheet.drawing_count, sheet.declared_rows, sheet.declared_columns) == (1, 9, 4)
    assert (sheet.state, sheet.sheet_name) == ("visible", "One")
    small, _ = scan_workbook_parts(books(spark, xlsx(SHEET, SHARED)), read_limit=150)
    assert small.filter("skipped").count() >= 1
    assert st.workbook_structure(small).head().skipped_part_count >= 1


def test_sheets_are_found_by_relationship_at_any_size(spark):
    rows_ = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(5, 60_000))
    book = xlsx(SHEET.replace("</sheetData>", rows_ + "</sheetData>"), SHARED)
    moved = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(moved, "w") as new:
        for name in old.namelist():
            data = old.read(name).replace(b"worksheets/sheet1.xml", b"data/one.xml")
            new.writestr(name.replace("xl/worksheets/sheet1.xml", "xl/data/one.xml"), data)
    for content in (book, moved.getvalue()):
        parts, _ = scan_workbook_parts(books(spark, content))
        sheet = st.sheet_structure(parts).head()
        assert (sheet.merged_range_count, sheet.merged_top_rows, sheet.hidden_row_count, sheet.drawing_count) == (2, 1, 1, 1)
        assert (sheet.declared_rows, sheet.declared_columns) == (9, 4)
        assert parts.filter("skipped").count() == 0


ORDER = {"records": ["id"], "summary": ["id"]}


def _outputs(spark):
    df = spark.range(100).selectExpr("id", "'v' || id AS name", "IF(id % 2 = 0, NULL, id) AS n")
    return {"records": df, "summary": df.limit(1)}


def test_artifacts_are_repeatable_and_never_overwritten(spark, tmp_path):
    texts = []
    for run, partitions in (("one", 1), ("two", 9)):
        target = tmp_path / run
        target.mkdir()
        outputs = {k: v.repartition(partitions) for k, v in _outputs(spark).items()}
        write_artifact_set(outputs, str(target), ORDER)
        lines = [r.line for r in read_artifact(spark, str(target), "records").collect()]
        texts.append(sorted(lines))
        with pytest.raises(OutputError) as error:
            write_artifact_set(outputs, str(target), ORDER)
        assert error.value.code == "OUTPUT_ALREADY_EXISTS"
    assert texts[0] == texts[1]
    assert texts[0][0] == '{"id":0,"n":null,"name":"v0"}'


def test_failed_write_leaves_nothing(spark, tmp_path):
    outputs = _outputs(spark)
    outputs["summary"] = outputs["summary"].select(F.expr("raise_error('stop')").alias("id"))
    with pytest.raises(OutputError) as error:
        write_artifact_set(outputs, str(tmp_path), ORDER)
    assert error.value.code == "OUTPUT_WRITE_FAILED"
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == []


class Killed(BaseException):
    """Stands for a driver that is gone: nothing of it cleans up."""


@pytest.mark.parametrize("step", ["_write_version", "_write_pointer", "_publish", "between artifacts", "inside the pointer", "after"])
def test_a_lost_driver_leaves_no_set_or_a_whole_one(spark, tmp_path, monkeypatch, step):
    outputs, target = _outputs(spark), str(tmp_path)

    def die(*args):
        raise Killed

    with monkeypatch.context() as patch:
        if step == "between artifacts":
            plain = artifacts._write_version
            patch.setattr(artifacts, "_write_version", lambda a, *rest: (plain({"records": a["records"]}, *rest), die()))
        elif step == "inside the pointer":
            patch.setattr(artifacts, "_write_pointer", lambda fs, path, version: (fs.create(path, False).close(), die()))
        elif step == "after":
            plain = artifacts._publish
            patch.setattr(artifacts, "_publish", lambda *args: (plain(*args), die()))
        else:
            patch.setattr(artifacts, step, die)
        with pytest.raises(Killed):
            write_artifact_set(outputs, target, ORDER)
    in_force = (tmp_path / artifacts.POINTER).exists()
    assert in_force is (step == "after")
    if in_force:
        with pytest.raises(OutputError):
            write_artifact_set(outputs, target, ORDER)
    else:
        write_artifact_set(outputs, target, ORDER)  # what was left behind does not hinder the next run
    assert [read_artifact(spark, target, n).count() for n in ("records", "summary")] == [100, 1]


def test_stages_are_removed_on_request(spark):
    stage = staged(spark.range(3), "trial")
    path = stage.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert stage.count() == 3 and os.path.isdir(path)
    assert drop_stages(spark) >= 1 and not os.path.exists(path)


def test_cluster_sessions_need_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: "yarn" if key == "spark.master" else default)
    with pytest.raises(RuntimeError):
        staged(spark.range(1), "trial")


def test_one_reading_gives_parts_rows_and_findings(spark, monkeypatch):
    good = xlsx(SHEET, SHARED, styles=STYLES)
    torn = xlsx(SHEET[:300], SHARED, styles=STYLES)
    files = books(spark, good, b"junk", torn, None)
    scanned = wb.scan_workbooks(files)
    columns = ("workbook_id", "entry_ordinal", "entry_name", "file_size", "text", "skipped")
    parts, unreadable = scan_workbook_parts(files)
    assert rows(scanned.parts, *columns) == rows(parts, *columns)
    assert rows(scanned.parts, "workbook_id", "entry_name", "counts")[-3:] == rows(parts, "workbook_id", "entry_name", "counts")[-3:]
    assert rows(scanned.container_findings, "subject_id", "code") == rows(unreadable, "subject_id", "code")
    assert {r.subject_id for r in scanned.load_findings.collect()} == {"W1", "W2", "W3"}
    assert rows(cells_of(scanned.rows), "row_ordinal", "column_ordinal", "cell_type") == rows(scanned.cells(), "row_ordinal", "column_ordinal", "cell_type")
    opened = []
    plain = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: opened.append(getattr(name, "filename", name)) or plain(self, name, *a, **k))
    list(wb._scanned("W", good, None, None, None))
    assert opened.count("xl/worksheets/sheet1.xml") == 1 and opened.count("xl/sharedStrings.xml") == 1


def test_long_sheets_and_many_strings_stay_out_of_memory(monkeypatch):
    monkeypatch.setattr(wb, "STRING_BYTES", 1000)
    monkeypatch.setattr(wb, "SPOOL_BYTES", 1000)
    monkeypatch.setattr(wb, "BATCH_CELLS", 500)
    n = 30_000
    body = "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>{i - 1}</v></c><c r="B{i}"><v>{i}</v></c></row>' for i in range(1, n + 1))
    shared = "<sst>" + "".join(f"<si><t>text é {i}</t></si>" for i in range(n)) + "</sst>"
    book = xlsx(f"<worksheet><sheetData>{body}</sheetData></worksheet>", shared)
    tracemalloc.start()
    seen, last = 0, None
    for batch in wb._scanned("W", book, None, None, None):
        if batch.column(0)[0].as_py() == wb.ROWS:
            seen += batch.num_rows
            last = batch.column(batch.schema.get_field_index("cells"))[-1].as_py()
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert seen == n and last[0]["value_string"] == f"text é {n - 1}" and last[1]["value_number"] == n
    assert peak < 12 << 20  # the sheet alone is 2 MB of XML, as a tree more than 30 MB


def test_inspection_stops_where_a_gate_closes(spark):
    macro, torn = io.BytesIO(xlsx(SHEET, SHARED, styles=STYLES)), xlsx(SHEET[:300], SHARED, styles=STYLES)
    with zipfile.ZipFile(macro, "a") as archive:
        archive.writestr("xl/vbaProject.bin", "x")
    good = xlsx(SHEET, SHARED, styles=STYLES)
    files = books(spark, good, b"junk", macro.getvalue(), torn, good, good, good)
    states = spark.createDataFrame(
        [("W0", "verified", None), ("W1", "verified", None), ("W2", "verified", None), ("W3", "verified", None), ("W4", "pending", None),
         ("W5", "invalid", "WORKBOOK_NOT_IN_MANIFEST")], "workbook_id string, manifest_state string, code string")
    got = inspect_workbooks(files, states, InspectionOptions(100, 50))
    codes = {}
    for r in got.findings.collect():
        codes.setdefault(r.subject_id, set()).add(r.code)
    assert codes["W1"] == {"INVALID_XLSX_CONTAINER"} and codes["W2"] == {"WORKBOOK_MACRO_DETECTED"}
    assert codes["W3"] == {"WORKBOOK_LOAD_FAILED", "WORKBOOK_XML_PART_SCAN_SKIPPED"}
    assert codes["W4"] == {"MANIFEST_NOT_VERIFIED"} and codes["W5"] == {"WORKBOOK_NOT_IN_MANIFEST"} and codes["W6"] == {"MANIFEST_INVALID"}
    assert {"WORKBOOK_FORMULA_PRESENT", "WORKBOOK_CELL_ERROR_PRESENT"} <= codes["W0"]
    assert rows(got.gate, "workbook_id", "inspection_completed", "accepted") == [("W0", True, True)] + [(f"W{i}", False, False) for i in range(1, 7)]
    assert not any(r.normalization_ready for r in got.summary.collect()) and got.profile.count() == 1
