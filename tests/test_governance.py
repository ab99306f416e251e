import hashlib
import json
from functools import reduce

import pytest
from pyspark.sql import functions as F

from steward.functions import variants as vr
from steward.operators import authorize as az, contracts as ct, decisions as dc, provenance as pv
from steward.sources.authorization_documents import read_authorization_documents
from tests.support import rows

# --- manifests ------------------------------------------------------------------------------------

CONTENT = "TEST-SYNTHETIC-BINARY-CONTENT-001"
HASH = hashlib.sha256(CONTENT.encode()).hexdigest()
ENTRY = dict(
    manifest_id="M", entry_index=0, source_id="TEST-SOURCE-001", fal_version="FALTEST",
    ontology_version="0.0.0-test", profile_version="kr-profile-0.0.0-test",
    source_file="files/test-source.bin", source_hash=HASH, resource_uri="urn:test:source:001",
    has_forbidden_field=False,
)
ENTRY_DDL = ", ".join(
    f"{k} {'bigint' if k == 'entry_index' else 'boolean' if k == 'has_forbidden_field' else 'string'}"
    for k in ENTRY
)


def verify(spark, *changes, version=1):
    data = [tuple({**ENTRY, "entry_index": i, **c}.values()) for i, c in enumerate(changes)]
    entries = spark.createDataFrame(data, ENTRY_DDL)
    manifests = spark.createDataFrame(
        [("M", version, False)], "manifest_id string, version int, pending_shape boolean"
    )
    return pv.verify_manifest(entries, _digests(spark), manifests)


def _digests(spark):
    return spark.createDataFrame(
        [("files/test-source.bin", 1, HASH), ("files/b.bin", 1, HASH)],
        "path string, length bigint, sha256 string",
    )


ENTRIES = [
        ({}, []),
        ({"source_file": "./files//test-source.bin"}, []),
        ({"source_hash": "0" * 64}, ["SOURCE_HASH_MISMATCH"]),
        ({"source_hash": "0" * 63}, ["SOURCE_HASH_FORMAT_INVALID"]),
        ({"source_hash": HASH.upper()}, ["SOURCE_HASH_FORMAT_INVALID"]),
        ({"source_hash": "sha256:" + HASH}, ["SOURCE_HASH_FORMAT_INVALID"]),
        ({"source_hash": HASH + "\n"}, ["SOURCE_HASH_FORMAT_INVALID"]),
        ({"source_hash": None}, ["MANIFEST_ENTRY_INVALID"]),
        ({"source_file": "files/none.bin"}, ["SOURCE_FILE_NOT_FOUND"]),
        ({"source_file": "/files/test-source.bin"}, ["SOURCE_PATH_OUTSIDE_BASE"]),
        ({"source_file": "../x"}, ["SOURCE_PATH_OUTSIDE_BASE"]),
        ({"has_forbidden_field": True, "source_hash": "x"}, ["MANIFEST_FORBIDDEN_FIELD"]),
        ({"source_id": "", "source_hash": "x"}, ["MANIFEST_ENTRY_INVALID", "SOURCE_HASH_FORMAT_INVALID"]),
]


def test_entry_checks(spark):
    data = [
        tuple({**ENTRY, "manifest_id": f"M{i}", **change}.values())
        for i, (change, _) in enumerate(ENTRIES)
    ]
    manifests = spark.createDataFrame(
        [(f"M{i}", 1, False) for i in range(len(ENTRIES))],
        "manifest_id string, version int, pending_shape boolean",
    )
    check = pv.verify_manifest(spark.createDataFrame(data, ENTRY_DDL), _digests(spark), manifests)
    found, passed = rows(check.findings, "subject_id", "code"), rows(check.entries, "manifest_id")
    for i, (change, expected) in enumerate(ENTRIES):
        assert [code for key, code in found if key == f"M{i}"] == expected, change
        assert ((f"M{i}",) in passed) is (not expected), change


def test_manifests_pass_whole_or_not_at_all(spark):
    other = {"source_id": "B", "source_file": "files/b.bin"}
    assert verify(spark, {}, other).entries.count() == 2
    assert verify(spark, {}, {**other, "source_hash": "0" * 64}).entries.count() == 0
    twice = verify(spark, {}, {"source_file": "files/b.bin"})
    assert rows(twice.findings, "code", "path") == [("MANIFEST_CONTRACT_INVALID", "$")]
    assert rows(verify(spark, {}, version=0).findings, "path") == [("$.version",)]
    assert rows(verify(spark).findings, "path") == [("$.sources",)]


def test_manifest_states(spark):
    books = spark.createDataFrame(
        [("W1", "M", "files/test-source.bin"), ("W2", "M", "files/other.bin")],
        "workbook_id string, manifest_id string, path string",
    )
    assert rows(pv.manifest_state(books, verify(spark, {})), "workbook_id", "manifest_state", "code") == [
        ("W1", "verified", None), ("W2", "invalid", "WORKBOOK_NOT_IN_MANIFEST"),
    ]


def test_evidence(spark):
    data = [
        ("ok", {}, True, "approved"), ("unverified", {}, False, "review_required"),
        ("open", {}, True, "draft"), ("claim", {}, False, "approved"),
        ("bad", {"source_hash": "x", "source_id": ""}, True, "approved"),
        ("up", {"source_file": "a/../b"}, True, "approved"),
    ]
    table = spark.createDataFrame(
        [(n, *{**ENTRY, **c}.values(), v, s) for n, c, v, s in data],
        f"entry_id string, {ENTRY_DDL}, verified boolean, status string",
    )
    evidence, findings = pv.evidence_build(table)
    assert rows(evidence, "evidence_id") == [("evidence:TEST-SOURCE-001",)]
    assert rows(findings, "subject_id", "code", "path") == [
        ("bad", "SOURCE_ENTRY_INVALID", "$.source_hash"), ("bad", "SOURCE_ENTRY_INVALID", "$.source_id"),
        ("claim", "SOURCE_ENTRY_INVALID", "$"), ("open", "SOURCE_NOT_APPROVED", "$.status"),
        ("unverified", "SOURCE_NOT_VERIFIED", "$.verified"), ("up", "SOURCE_ENTRY_INVALID", "$"),
    ]


# --- contracts ------------------------------------------------------------------------------------


def test_ontology_rows(spark):
    table = spark.createDataFrame(
        [
            ("occ-a", "ds-a", "TEST-ELEMENT-001", "TEST/PATH/A", 1, "approved"),
            ("occ-b", "ds-b", "", "TEST/PATH/B", 0, None),
            ("occ-c", "ds-c", "E", None, None, "approved"),
            ("occ-d", "ds-d", "E", None, None, None),
        ],
        "occurrence_id string, dataset_id string, element_imo_id string, technical_position string, "
        "sequence int, status string",
    )
    valid, findings = ct.validate_contract(table, "ElementOccurrence", "occurrence_id")
    assert rows(valid, "occurrence_id", "status") == [("occ-a", "approved"), ("occ-d", "draft")]
    assert rows(findings, "subject_id", "path") == [
        ("occ-b", "$.element_imo_id"), ("occ-b", "$.sequence"), ("occ-c", "$"),
    ]
    with pytest.raises(ValueError, match="UNSUPPORTED_MODEL_NAME"):
        ct.validate_contract(table, "Nothing", "occurrence_id")


FINDING = ("severity:string,code:string,message:string,rule_id:string,related_rule_ids:array<string>,"
           "path:string,actual_value:string,expected:string,evidence_refs:array<string>")
EVIDENCE = "evidence_id:string,fal_version:string,ontology_version:string,profile_version:string"
RESULT_DDL = (
    f"result_id string, status string, human_review_required boolean, "
    f"errors array<struct<{FINDING}>>, warnings array<struct<{FINDING}>>, evidence array<struct<{EVIDENCE}>>"
)


def finding(severity="ERROR", code="VAL_TEST_001", refs=None):
    return (severity, code, "m", "urn:test:rule", None, None, None, None, refs)


EV = ("evidence:A", "F", "O", "P")


@pytest.mark.parametrize(
    ("row", "paths"),
    [
        (("PASS", False, None, None, [EV]), []),
        (("PASS", True, None, None, None), ["$"]),
        (("PASS", False, [finding()], None, None), ["$"]),
        (("FAIL", True, [finding()], None, None), []),
        (("FAIL", False, [finding()], None, None), ["$"]),
        (("WARNING", True, None, [finding("WARNING")], None), []),
        (("WARNING", True, None, [finding("ERROR")], None), ["$"]),
        (("FAIL", True, [finding(refs=["evidence:A"])], None, [EV]), []),
        (("FAIL", True, [finding(refs=["evidence:X"])], None, [EV]), ["$"]),
        (("PASS", False, None, None, [EV, EV]), ["$"]),
        (("DONE", None, [finding(code="")], None, [("", "F", None, "P")]),
         ["$.errors.0.code", "$.evidence.0.evidenceId", "$.evidence.0.ontologyVersion",
          "$.humanReviewRequired", "$.status"]),
    ],
)
def test_nested_results(spark, row, paths):
    table = spark.createDataFrame([("R", *row)], RESULT_DDL)
    valid, findings = ct.validate_contract(table, "SkillResult", "result_id")
    assert [p for (p,) in rows(findings, "path")] == paths
    assert valid.count() == (0 if paths else 1)
    if not paths:
        assert "humanReviewRequired" in valid.columns


def test_long_form_agrees_with_nested(spark):
    table = spark.createDataFrame(
        [("R1", "PASS", False, [finding()], None, [EV, EV]),
         ("R2", "FAIL", True, [finding("WARNING", refs=["evidence:X"])], None, [EV])], RESULT_DDL
    )
    child = dc.result_tables(table)
    assert rows(dc.check_result_severity(child["findings"]), "result_id", "problem") == [
        ("R2", "errors_not_error")]
    assert rows(dc.check_result_status(table, child["findings"]), "result_id", "problem") == [
        ("R1", "pass_with_errors")]
    assert rows(dc.check_evidence_refs(child["evidence"], child["refs"]), "result_id", "problem") == [
        ("R1", "duplicate_evidence_id"), ("R2", "dangling_reference")]


def test_schema_documents(spark):
    docs = spark.createDataFrame(
        [(1, "ontology", '{"$defs":{"DataElement":{},"ElementOccurrence":{"properties":{"element_imo_id":{}}}}}'),
         (2, "ontology", '{"$defs":{"ElementOccurrence":{"properties":{"elementImoId":{}}}}}'),
         (3, "validation", '{"x":1}'), (4, "validation", "[]"), (5, "other", "{}")],
        "doc_id int, schema_name string, doc string",
    )
    assert rows(ct.json_contract_check(docs), "doc_id", "code") == [
        (2, "SCH_006"), (2, "SCH_007"), (2, "SCH_008"), (3, "SCH_005"), (4, "SCH_004"), (5, "SCH_002")]
    wanted = spark.createDataFrame([(1, "ontology"), (7, "validation"), (8, "other"), (9, None)], "doc_id int, schema_name string")
    assert rows(ct.json_contract_check(docs, wanted), "doc_id", "code") == [(7, "SCH_003"), (8, "SCH_002"), (9, "SCH_002")]
    last = spark.createDataFrame(
        [(1, "validation", '{"$defs":{"SkillResult":{"properties":{"humanReviewRequired":1}}},"$defs":{"SkillResult":"{}"}}'),
         (2, "validation", '{"$defs":{"SkillResult":{"properties":[]},"SkillResult":{"properties":{"humanReviewRequired":null}}}}'),
         (3, "validation", '{"$defs":{"SkillResult":{"properties":["humanReviewRequired"]}}} x')],
        "doc_id int, schema_name string, doc string")
    assert rows(ct.json_contract_check(last), "doc_id", "code") == [(1, "SCH_006"), (3, "SCH_004")]


def test_documents_are_single_strict_values(spark):
    vr.last_key_counts(spark)
    texts = ['{"a":1}', '{"a":1} ', '{"a":1}x', '{"a":1}{}', '{"a":1},{}', '{}] junk', '{},"x"]', "[]", "", " ", None, '{"a":1,"a":"z"}', "{'a':1}", '"s"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    tree = vr.parsed(F.col("t"))
    got = {r.i: r.a for r in df.select("i", tree.isNotNull().alias("a")).collect()}
    assert [i for i in got if got[i]] == [0, 1, 7, 11, 13]
    objects = df.select("i", vr.members(tree).isNotNull().alias("o")).filter("o").collect()
    assert {r.i for r in objects} == {0, 1, 11}
    values = '{"n":1,"f":1.5,"w":2.0,"e":1e3,"b":true,"s":"1","z":null,"big":9999999999,"o":{},"l":[]}'
    one = spark.createDataFrame([(values,)], "t string").select(vr.members(vr.parsed(F.col("t"))).alias("m"))
    read = lambda as_type: {k: v for k, v in one.select(*[vr.scalar(vr.member(F.col("m"), k), as_type).alias(k) for k in "n f w e b s z big o l absent".split()])
                            .head().asDict().items() if v is not None}
    assert read("int") == {"n": 1, "w": 2, "e": 1000} and read("json int") == {"n": 1}
    assert read("boolean") == {"b": True} and read("string") == {"s": "1"}


def test_authorization_documents(spark):
    auth = {"version": 1, "source_id": "S", "inspectionReportId": "x", "outputStorageClass": "internal-restricted", "approvedOutputRootId": "R",
            "sheets": [{"sheetOrdinal": 0, "classification": "code_list", "normalize": False, "headerConfidence": "none"}, 5, {"sheet_ordinal": 1}],
            "humanReviewCompleted": True, "sourceId": "T"}
    report = {"reportVersion": True, "sheets": [{"sheetOrdinal": 1.0}, 3, {"sheetOrdinal": 2}], "findings": "none", "summary": []}
    docs = spark.createDataFrame([("A", json.dumps(auth), json.dumps(report), '{"version":1}', "/out"), ("B", None, "[]", "{", None)],
                                 "authorization_id string, authorization string, report string, binding string, output_dir string")
    read = read_authorization_documents(docs)
    found = rows(read.findings, "authorization_id", "code", "path", "field")
    assert [f for f in found if f[0] == "B"] == [("B", c, "$", None) for c in (
        "AUTHORIZATION_JSON_INVALID", "INSPECTION_REPORT_INVALID", "OUTPUT_ROOT_BINDING_JSON_INVALID")]
    of_a = {(p, f) for a, _, p, f in found if a == "A"}
    assert ("$.authorization", "source_id") in of_a  # both spellings
    assert ("$.authorization.sheets.1", None) in of_a and ("$.authorization.sheets.2", "classification") in of_a
    assert ("$.binding", "rootId") in of_a and ("$.authorization.sheets.0", "classification") not in of_a
    assert read.authorizations.head().source_id == "T" and read.acks.count() == 0
    sheet = read.auth_sheets.filter("sheet_index = 0").head()
    assert (sheet.medium_confidence_approved, sheet.header_row, sheet.exclusion_reason_code) == (False, None, None)
    head = read.reports.head()
    assert (head.report_version, head.provenance_verified, head.inspection_completed, head.source_id) == (None, False, False, None)
    assert [r.sheet_ordinal for r in read.report_sheets.orderBy("sheet_index").collect()] == [None, None, 2]
    assert read.report_findings.count() == 0 and read.output_bindings.count() == 1


# --- authorizations ---------------------------------------------------------------------------------

REPORT = "TEST-REPORT"
REPORT_ID = hashlib.sha256(REPORT.encode()).hexdigest()


def bundle(spark, *, auth=None, report=None, sheets=None, report_sheets=None, findings=(), acks=(),
           reviews=(), binding=None, key="X"):
    a = {"version": 1, "source_id": "SRC", "inspection_report_id": REPORT_ID,
         "output_storage_class": "internal-restricted", "approved_output_root_id": "TEST-ROOT",
         "human_review_completed": True, **(auth or {})}
    r = {"report_version": 1, "provenance_verified": True, "manifest_status": "verified",
         "inspection_mode": "verified-source", "inspection_completed": True, "source_id": "SRC",
         "report_text": REPORT, **(report or {})}
    b = {"version": 1, "root_id": "TEST-ROOT", "storage_class": "internal-restricted",
         "root_path": "/r/a", "output_dir": "/r/a/out", **(binding or {})}
    sheets = sheets or [
        (0, "data_table", True, 1, "high", False, None),
        (1, "excluded_non_data", False, None, "none", False, "TEST_EXCLUSION_001"),
    ]
    report_sheets = report_sheets or [(0, 1, "high"), (1, None, "none")]
    review_bools = ", ".join(
        f"{c} boolean" for c in ("completed", "reference_model_alignment_approved",
                                 "model_reference_scope_approved", "model_reference_reviewer_recorded"))

    def table(data, ddl):
        return spark.createDataFrame([(key, *d) for d in data], "authorization_id string, " + ddl)

    def record(d):
        types = {bool: "boolean", int: "int", str: "string"}
        return table([tuple(d.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in d.items()))

    return [
        record(a),
        table([(i, *s) for i, s in enumerate(sheets)],
              "sheet_index bigint, sheet_ordinal int, classification string, normalize boolean, header_row int, "
              "header_confidence string, medium_confidence_approved boolean, exclusion_reason_code string"),
        table(acks, "code string, sheet_ordinal int, disposition string, reason_code string"),
        table(reviews, f"sheet_ordinal int, drawing_review_category string, {review_bools}, "
              "evidence_reference_id string, external_verification_asserted boolean, "
              "external_verification_technically_confirmed boolean"),
        record(r),
        table([(i, *s) for i, s in enumerate(report_sheets)],
              "sheet_index bigint, sheet_ordinal int, inferred_header_row int, header_confidence string"),
        table([(i, *f) for i, f in enumerate(findings)],
              "finding_index bigint, severity string, code string, path string"),
        record(b),
    ]


OK = ("accepted_for_reviewed_scope", "TEST_REASON_001")
DRAWN = ("WARNING", "WORKBOOK_DRAWING_ONLY_SHEET", "$.sheets.1")
DRAWN_ACK = ("WORKBOOK_DRAWING_ONLY_SHEET", 1, *OK)
MODEL = [(0, "data_table", True, 1, "high", False, None),
         (1, "model_reference", False, None, "none", False, None)]
REVIEW = (1, "imo_compendium_model_reference", True, True, True, True, "TEST-REVIEW-001", True, False)
EMPTY = ("WARNING", "WORKBOOK_EMPTY_SHEET", "$.sheets.1")

CASES = [
    ({}, {}),
    ({"auth": {"inspection_report_id": "0" * 64}}, {"INSPECTION_REPORT_ID_MISMATCH": 1}),
    ({"auth": {"inspection_report_id": "X"}}, {"AUTHORIZATION_INVALID": 1}),
    ({"auth": {"version": 0, "approved_output_root_id": "a/b"}}, {"AUTHORIZATION_INVALID": 2}),
    ({"auth": {"source_id": "OTHER"}}, {"SOURCE_ID_MISMATCH": 1}),
    ({"auth": {"human_review_completed": False}}, {"HUMAN_REVIEW_INCOMPLETE": 1}),
    ({"report": {"report_version": 2}, "auth": {"inspection_report_id": "0" * 64, "source_id": "O"}},
     {"REPORT_VERSION_UNSUPPORTED": 1, "INSPECTION_REPORT_ID_MISMATCH": 1}),
    ({"report": {"manifest_status": "pending"}}, {"REPORT_NOT_VERIFIED": 1}),
    ({"report_sheets": [(0, 1, "high")]}, {"SHEET_AUTHORIZATION_EXTRA": 1}),
    ({"report_sheets": [(0, 1, "high"), (1, None, "none"), (2, None, "none")]},
     {"SHEET_AUTHORIZATION_MISSING": 1}),
    ({"report_sheets": [(0, 2, "medium"), (1, None, "none"), (1, 5, "high"), (-1, 1, "high")]},
     {"HEADER_ROW_MISMATCH": 1, "HEADER_CONFIDENCE_MISMATCH": 1, "REPORT_SHEET_ORDINAL_DUPLICATE": 1,
      "REPORT_SHEET_ORDINAL_INVALID": 1}),
    ({"findings": [EMPTY]}, {"FINDING_AUTHORIZATION_MISSING": 1}),
    ({"findings": [EMPTY], "acks": [("WORKBOOK_EMPTY_SHEET", 1, *OK)]}, {}),
    ({"findings": [EMPTY, EMPTY], "acks": [("WORKBOOK_EMPTY_SHEET", 1, *OK)]},
     {"REPORT_FINDING_DUPLICATE": 1}),
    ({"findings": [EMPTY], "acks": [("WORKBOOK_EMPTY_SHEET", 1, "resolved", "TEST_REASON_001")]},
     {"BLOCKING_FINDING_UNRESOLVED": 1}),
    ({"findings": [("WARNING", "WORKBOOK_SCAN_LIMIT_REACHED", "$.sheets.0")],
      "acks": [("WORKBOOK_SCAN_LIMIT_REACHED", 0, *OK)]}, {"CURRENT_REPORT_BLOCKING_FINDING": 1}),
    ({"findings": [("WARNING", "WORKBOOK_FORMULA_PRESENT", "$.workbook")],
      "acks": [("WORKBOOK_FORMULA_PRESENT", None, *OK)]}, {"UNKNOWN_FINDING_BLOCKING": 1}),
    ({"findings": [("ERROR", "WORKBOOK_CUSTOM_XML_PRESENT", None)],
      "acks": [("WORKBOOK_CUSTOM_XML_PRESENT", None, *OK)]}, {"FATAL_FINDING_PRESENT": 1}),
    ({"acks": [("WORKBOOK_CUSTOM_XML_PRESENT", None, *OK)]}, {"FINDING_AUTHORIZATION_STALE": 1}),
    ({"acks": [("X", None, *OK), ("X", None, *OK)]}, {"AUTHORIZATION_INVALID": 1}),
    ({"findings": [("WARNING", "WORKBOOK_EMPTY_SHEET", "$.sheets.0")],
      "acks": [("WORKBOOK_EMPTY_SHEET", 0, *OK)]}, {"EMPTY_SHEET_CLASSIFICATION_INVALID": 1}),
    ({"findings": [DRAWN], "acks": [DRAWN_ACK]},
     {"MODEL_REFERENCE_AUTHORIZATION_CLASSIFICATION_UNRESOLVED": 1}),
    ({"findings": [DRAWN], "acks": [DRAWN_ACK],
      "reviews": [(1, "out_of_scope_visual", True, False, False, False, None, False, False)]}, {}),
    ({"findings": [DRAWN], "acks": [DRAWN_ACK], "sheets": MODEL}, {"MODEL_REFERENCE_REVIEW_REQUIRED": 1}),
    ({"findings": [DRAWN], "acks": [DRAWN_ACK], "sheets": MODEL, "reviews": [REVIEW]}, {}),
    ({"findings": [DRAWN], "acks": [DRAWN_ACK], "sheets": MODEL,
      "reviews": [(1, "imo_compendium_model_reference", False, False, False, False, None, True, True)]},
     {"MODEL_REFERENCE_REVIEW_REQUIRED": 1, "REFERENCE_MODEL_ALIGNMENT_NOT_APPROVED": 1,
      "MODEL_REFERENCE_SCOPE_NOT_APPROVED": 1, "MODEL_REFERENCE_REVIEWER_NOT_RECORDED": 1,
      "MODEL_REFERENCE_REVIEW_EVIDENCE_NOT_VERIFIED": 1}),
    ({"sheets": MODEL, "reviews": [REVIEW]}, {"MODEL_REFERENCE_CLASSIFICATION_INVALID": 2}),
    ({"sheets": [(0, "metadata_or_readme", False, None, "none", False, "TEST_EXCLUSION_001"),
                 (1, "excluded_non_data", False, None, "none", False, "TEST_EXCLUSION_001")]},
     {"NO_NORMALIZE_TARGET_SHEET": 1}),
    ({"sheets": [(0, "data_table", True, 1, "medium", False, None),
                 (1, "code_list", True, None, "none", False, None)]}, {"AUTHORIZATION_INVALID": 2}),
    ({"binding": {"root_id": "OTHER-ROOT", "output_dir": "/r/ab"}},
     {"OUTPUT_ROOT_ID_MISMATCH": 1, "OUTPUT_DIR_OUTSIDE_APPROVED_ROOT": 1}),
    ({"binding": {"root_path": "r/a"}}, {"OUTPUT_ROOT_BINDING_INVALID": 1}),
]


def test_authorizations(spark):
    """All cases at once: one job judges many authorizations, and they do not touch each other."""
    bundles = [bundle(spark, **changes, key=f"X{i}") for i, (changes, _) in enumerate(CASES)]
    tables = [reduce(lambda x, y: x.unionByName(y), parts) for parts in zip(*bundles, strict=True)]
    tables = [spark.createDataFrame(t.collect(), t.schema) for t in tables]
    found = {}
    for r in az.authorization_findings(*tables).collect():
        case = found.setdefault(r.authorization_id, {})
        case[r.code] = case.get(r.code, 0) + r.occurrences
    verdicts = {r.authorization_id: r for r in az.authorization_verdict(*tables).collect()}
    for i, (changes, expected) in enumerate(CASES):
        verdict = verdicts[f"X{i}"]
        assert found.get(f"X{i}", {}) == expected, changes
        assert verdict.valid is (not expected), changes
        assert verdict.finding_count == sum(expected.values()), changes
        if verdict.valid:
            assert verdict.blocking_finding_count == 0 and verdict.output_root_authorized


def test_gate_names_flags_and_codes(spark):
    tables = bundle(spark, auth={"human_review_completed": False})
    verdicts, found = az.authorization_verdict(*tables), az.authorization_findings(*tables)
    assert [d for (d,) in rows(az.authorization_gate(verdicts, found), "detail")] == [
        "HUMAN_REVIEW_INCOMPLETE", "human_review_completed", "valid"]
    lacking = verdicts.selectExpr("* EXCEPT (valid)", "CAST(NULL AS BOOLEAN) AS valid")
    assert ("AUTHORIZATION_FLAG_MISSING", "valid") in rows(
        az.authorization_gate(lacking, found), "code", "detail")


# --- decisions --------------------------------------------------------------------------------------


def decision(key, *, status="APPROVED", review=False, findings=(), refs=(), sources=(), results=None,
             items=None, subject="S"):
    """Rows of one decision for the six input tables."""
    results = [(0, "PASS", False)] if results is None else results
    items = [(0, 0, "evidence:A", "h1")] if items is None else items
    header = [("MAPPING", status, subject, "s", "r", review)]
    return [[(key, *d) for d in data] for data in (header, findings, refs, sources, results, items)]


DECISION_TABLES = (
    "decision_type string, status string, subject_id string, summary string, rationale string, "
    "human_review_required boolean",
    "finding_index bigint, severity string", "finding_index bigint, ref string",
    "result_index bigint, status string", "result_index bigint, status string, has_errors boolean",
    "result_index bigint, item_index bigint, evidence_id string, source_hash string",
)


DECISIONS = [
        ({}, []),
        ({"review": True}, ["GOVERNANCE_RESULT_INVALID"]),
        ({"sources": [(0, "FAIL")]}, ["GOVERNANCE_RESULT_INVALID"]),
        ({"status": "REJECTED", "review": True, "findings": [(0, "ERROR")]}, []),
        ({"status": "REJECTED", "review": True, "findings": [(0, "WARNING")]}, ["GOVERNANCE_RESULT_INVALID"]),
        ({"status": "REVIEW_REQUIRED", "review": True}, ["GOVERNANCE_RESULT_INVALID"]),
        ({"findings": [(0, "WARNING")], "refs": [(0, "evidence:X")]}, ["GOVERNANCE_RESULT_INVALID"]),
        ({"subject": ""}, ["GOVERNANCE_RESULT_INVALID"]),
        ({"results": [], "items": []}, ["GOVERNANCE_EVIDENCE_REQUIRED"]),
        ({"results": [(0, "FAIL", True)]}, ["EVIDENCE_RESULT_NOT_SUCCESSFUL"]),
        ({"results": [(0, "PASS", False), (1, "PASS", False)]}, ["EVIDENCE_RESULT_NOT_SUCCESSFUL"]),
        ({"items": [(0, 0, "evidence:A", "h1"), (0, 1, "evidence:A", "h1")]}, []),
        ({"items": [(0, 0, "evidence:A", "h1"), (0, 1, "evidence:A", "h2"), (0, 2, "evidence:A", None)]},
         ["EVIDENCE_ID_CONFLICT", "EVIDENCE_ID_CONFLICT"]),
]


def test_assembly(spark):
    made = [decision(f"D{i}", **changes) for i, (changes, _) in enumerate(DECISIONS)]
    tables = [
        spark.createDataFrame(sum(parts, []), "decision_id string, " + ddl)
        for parts, ddl in zip(zip(*made, strict=True), DECISION_TABLES, strict=True)
    ]
    assembled, evidence, findings = dc.assemble_decisions(*tables)
    passed = {r.decision_id for r in assembled.collect()}
    merged = [r.decision_id for r in evidence.collect()]
    found = rows(findings, "decision_id", "code")
    for i, (changes, expected) in enumerate(DECISIONS):
        assert [code for key, code in found if key == f"D{i}"] == expected, changes
        assert (f"D{i}" in passed) is (not expected), changes
        assert merged.count(f"D{i}") == (0 if expected else 1), changes


def test_evidence_without_id_conflicts_with_nothing(spark):
    schema = "decision_id string, result_index bigint, item_index bigint, evidence_id string, source_hash string, is_good boolean"
    items = spark.createDataFrame(
        [("D", 0, 0, None, "h1", True), ("D", 0, 1, None, "h2", True), ("D", 1, 0, "A", None, True), ("D", 1, 1, "A", "h", True)], schema)
    marked = rows(dc.marked_evidence(items), "item_index", "result_index", "is_first", "conflicts")
    assert sorted(marked) == [(0, 0, True, False), (0, 1, True, False), (1, 0, False, False), (1, 1, False, True)]
    assert rows(dc.first_evidence(items), "result_index", "item_index") == [(0, 0), (1, 0)]


def test_assembly_of_empty_tables(spark):
    tables = [spark.createDataFrame([], "decision_id string, " + ddl) for ddl in DECISION_TABLES]
    assert [df.count() for df in dc.assemble_decisions(*tables)] == [0, 0, 0]


def test_assembly_reads_its_inputs_once(spark):
    """Results come from the two written tables; of the inputs only the evidence results are read again."""
    made = decision("D")
    tables = [spark.createDataFrame(part, "decision_id string, " + ddl) for part, ddl in zip(made, DECISION_TABLES, strict=True)]
    for df, most in zip(dc.assemble_decisions(*tables), (1, 2, 4), strict=True):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") + plan.count("LogicalRDD") <= most, plan


def test_snapshot_drift(spark):
    made = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, content string")
    kept = spark.createDataFrame([("a", "1"), ("b", "2 "), ("x", "9")], "name string, content string")
    assert rows(dc.snapshot_drift(made, kept), "name", "drift") == [("b", "different"), ("c", "missing")]
