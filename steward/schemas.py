"""Canonical table shapes and the fixed vocabulary of the governed data model."""

from __future__ import annotations

from pyspark.sql import types as T

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_TEXT, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()
_VALUES = {
    "value_string": _TEXT, "value_number": T.DoubleType(), "value_boolean": T.BooleanType(),
    "value_timestamp": T.TimestampType(),
}

FINDING = _struct(subject_id=_TEXT, severity=_TEXT, code=_TEXT, path=_TEXT)
CELL_VALUE = _struct(raw_type=_TEXT, date_format=T.BooleanType(), **_VALUES)
CELL_KEYS = {
    "workbook_id": _TEXT, "sheet_ordinal": _INT, "row_ordinal": _LONG, "column_ordinal": _INT,
}
RAW_CELLS = _struct(**CELL_KEYS, raw_type=_TEXT, date_format=T.BooleanType(), **_VALUES)
CELLS = _struct(**CELL_KEYS, cell_type=_TEXT, **_VALUES)

# --- fixed values of the data model -----------------------------------------------------------

CELL_CATEGORIES = (
    "blank", "string", "number", "boolean", "date",
    "formula", "error", "inline_string", "unknown",
)
VALUE_TYPES = ("string", "number", "integer", "boolean", "date")
ERROR, WARNING = "ERROR", "WARNING"

HEADER_SCAN_DEPTH = 10
XML_PART_READ_LIMIT = 100 * 1024 * 1024
HASH_CHUNK = 1024 * 1024
SUPPORTED_REPORT_VERSION = 1

GOVERNANCE_STATUSES = ("draft", "approved", "review_required", "unresolved", "deprecated")
RESULT_STATUSES = ("PASS", "WARNING", "FAIL")
FINDING_SEVERITIES = (ERROR, WARNING)
DECISION_STATUSES = ("APPROVED", "REVIEW_REQUIRED", "REJECTED")
DECISION_TYPES = (
    "DATASET", "DATA_ELEMENT", "ELEMENT_OCCURRENCE", "MAPPING", "BUSINESS_RULE", "DATA_QUALITY",
)
SHEET_CLASSIFICATIONS = (
    "data_table", "code_list", "metadata_or_readme", "excluded_non_data", "model_reference",
)
HEADER_CONFIDENCES = ("high", "medium", "low", "none")
FINDING_DISPOSITIONS = ("resolved", "accepted_for_reviewed_scope", "remains_blocking")
MODEL_REFERENCE_CATEGORY = "imo_compendium_model_reference"
DRAWING_REVIEW_CATEGORIES = (
    MODEL_REFERENCE_CATEGORY, "documentation", "out_of_scope_visual",
    "separate_visual_review_required", "undecided",
)
STORAGE_CLASS = "internal-restricted"

SHA256_PATTERN = r"[0-9a-f]{64}"
REASON_CODE_PATTERN = r"[A-Z][A-Z0-9_]{2,63}"
ROOT_ID_PATTERN = r"[A-Z][A-Z0-9_-]{2,63}"

BLOCKING_CODES = (
    "WORKBOOK_SCAN_LIMIT_REACHED",
    "WORKBOOK_HEADER_NOT_DETECTED",
    "WORKBOOK_XML_PART_SCAN_SKIPPED",
)
REVIEWABLE_CODES = (
    "WORKBOOK_DECLARED_DIMENSION_EXCESSIVE",
    "WORKBOOK_PROTECTION_ENABLED",
    "WORKBOOK_CUSTOM_XML_PRESENT",
    "WORKBOOK_DIGITAL_SIGNATURE_PRESENT",
    "WORKBOOK_EMPTY_SHEET",
    "WORKBOOK_DRAWING_ONLY_SHEET",
)
EMPTY_SHEET, DRAWING_ONLY_SHEET = "WORKBOOK_EMPTY_SHEET", "WORKBOOK_DRAWING_ONLY_SHEET"

#: finding code -> (allowed sheet classifications, code raised otherwise)
NON_TABULAR_POLICY = {
    EMPTY_SHEET: (
        ("metadata_or_readme", "excluded_non_data"),
        "EMPTY_SHEET_CLASSIFICATION_INVALID",
    ),
    DRAWING_ONLY_SHEET: (
        ("metadata_or_readme", "excluded_non_data", "model_reference"),
        "DRAWING_ONLY_SHEET_CLASSIFICATION_INVALID",
    ),
}
#: drawing review category -> the classification it resolves to
DRAWING_RESOLUTIONS = {
    "documentation": "metadata_or_readme",
    "out_of_scope_visual": "excluded_non_data",
}
AUTHORIZATION_FLAGS = (
    "valid",
    "report_identity_matched",
    "sheet_coverage_complete",
    "finding_coverage_complete",
    "output_root_authorized",
    "human_review_completed",
)
VALUE_POLICY = {
    "public": "raw_value_allowed",
    "internal": "masked_value_only",
    "confidential": "hash_only",
    "secret": "never_log",
}
MANIFEST_FORBIDDEN_FIELDS = ("verified", "status")
PENDING_REQUIRED_KEYS = ("standard", "files", "ingestion")
PENDING_ALLOWED_KEYS = ("standard", "source", "files", "ingestion")
PENDING_STATUS = "pending_source"

#: schema name -> (definition, required properties, forbidden properties)
SCHEMA_CONTRACTS = {
    "validation": (("SkillResult", ("humanReviewRequired",), ("human_review_required",)),),
    "ontology": (
        ("DataElement", (), ()),
        ("ElementOccurrence", ("element_imo_id",), ("elementImoId",)),
    ),
}
ARTIFACTS = {
    "records": "normalized-records.local.json",
    "findings": "normalization-findings.local.json",
    "evidence": "mapping-evidence.local.json",
    "summary": "normalization-summary.local.json",
}
