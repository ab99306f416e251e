"""Row contracts: declarative field rules and ordered invariants.

All field errors of a row are reported. Invariants run only on rows without field errors, in
declaration order, and only the first failing one counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from steward.functions.jsontext import is_json_object
from steward.functions.variants import last_key_counts, member, members, parsed
from steward.functions.naming import alias_columns, to_camel
from steward.functions.paths import absolute_sql, parent_segment_sql
from steward.functions.text import matches, matches_sql
from steward import schemas as S


@dataclass(frozen=True)
class Rule:
    """What one field must satisfy. Null counts as absent."""

    name: str
    required: bool = True
    min_length: int | None = None
    pattern: str | None = None
    ge: int | None = None
    values: tuple[str, ...] | None = None
    min_items: int | None = None
    absolute_path: bool = False
    default: object = None
    default_type: str | None = None
    items: tuple[Rule, ...] = field(default=())


def text(name: str, **kw) -> Rule:
    return Rule(name, min_length=1, **kw)


def optional(name: str, **kw) -> Rule:
    return Rule(name, required=False, **kw)


def choice(name: str, values: tuple[str, ...], **kw) -> Rule:
    return Rule(name, values=values, **kw)


def flag(name: str) -> Rule:
    """A boolean that may be absent and then is false."""
    return Rule(name, required=False, default=False, default_type="boolean")


def listing(name: str, items: tuple[Rule, ...] = (), element: str = "string") -> Rule:
    return Rule(name, required=False, default=[], default_type=f"array<{element}>", items=items)


_STATUS = Rule("status", required=False, values=S.GOVERNANCE_STATUSES, default="draft",
               default_type="string")
_EVIDENCE = (
    text("evidence_id"), text("fal_version"), text("ontology_version"), text("profile_version"),
    optional("resource_uri"), optional("source_file"), optional("source_hash"),
)
_FINDING = (
    choice("severity", S.FINDING_SEVERITIES), text("code"), text("message"), text("rule_id"),
    listing("related_rule_ids"), optional("path"), optional("actual_value"),
    optional("expected"), listing("evidence_refs"),
)

ENTITIES: dict[str, tuple[Rule, ...]] = {
    "Dataset": (
        text("dataset_id"), text("fal_version"), text("name"), optional("description"), _STATUS,
    ),
    "Component": (
        text("component_id"), text("dataset_id"), text("name"), optional("parent_component_id"),
        optional("sequence", ge=1), _STATUS,
    ),
    "DataElement": (
        text("imo_id"), text("name"), optional("definition"), optional("data_format"),
        optional("representation_term"), _STATUS,
    ),
    "ElementOccurrence": (
        text("occurrence_id"), text("dataset_id"), text("element_imo_id"),
        optional("technical_position"), optional("parent_component_id"),
        optional("sequence", ge=1), optional("cardinality"), optional("usage"), _STATUS,
    ),
    "CodeList": (
        text("code_list_id"), text("fal_version"), text("name"), listing("codes"), _STATUS,
    ),
    "BusinessRule": (
        text("rule_id"), text("profile"), text("version"), text("description"), _STATUS,
    ),
    "Evidence": _EVIDENCE,
    "ValidationFinding": _FINDING,
    "SkillResult": (
        choice("status", S.RESULT_STATUSES), Rule("human_review_required"), optional("data"),
        listing("errors", _FINDING), listing("warnings", _FINDING), listing("evidence", _EVIDENCE),
    ),
}
#: Contracts used inside other operators, not selectable by name.
INTERNAL: dict[str, tuple[Rule, ...]] = {
    "SourceManifestEntry": (
        text("source_id"), text("fal_version"), text("ontology_version"), text("profile_version"),
        text("source_file"), Rule("source_hash", pattern=S.SHA256_PATTERN),
        optional("resource_uri"), Rule("verified"), choice("status", S.GOVERNANCE_STATUSES),
    ),
    "SheetAuthorization": (
        Rule("sheet_ordinal", ge=0), choice("classification", S.SHEET_CLASSIFICATIONS),
        Rule("normalize"), optional("header_row", ge=1),
        choice("header_confidence", S.HEADER_CONFIDENCES), flag("medium_confidence_approved"),
        optional("exclusion_reason_code", pattern=S.REASON_CODE_PATTERN),
    ),
    "FindingAuthorization": (
        text("code"), optional("sheet_ordinal", ge=0),
        choice("disposition", S.FINDING_DISPOSITIONS),
        Rule("reason_code", pattern=S.REASON_CODE_PATTERN),
    ),
    "ModelReferenceReview": (
        Rule("sheet_ordinal", ge=0),
        choice("drawing_review_category", S.DRAWING_REVIEW_CATEGORIES), Rule("completed"),
        flag("reference_model_alignment_approved"), flag("model_reference_scope_approved"),
        flag("model_reference_reviewer_recorded"),
        optional("evidence_reference_id", pattern=S.ROOT_ID_PATTERN),
        flag("external_verification_asserted"), flag("external_verification_technically_confirmed"),
    ),
    "NormalizationAuthorization": (
        Rule("version", ge=1), text("source_id"),
        Rule("inspection_report_id", pattern=S.SHA256_PATTERN),
        choice("output_storage_class", (S.STORAGE_CLASS,)),
        Rule("approved_output_root_id", pattern=S.ROOT_ID_PATTERN),
        Rule("human_review_completed"),
    ),
    "OutputRootBinding": (
        Rule("version", ge=1), Rule("root_id", pattern=S.ROOT_ID_PATTERN),
        choice("storage_class", (S.STORAGE_CLASS,)),
        Rule("root_path", min_length=1, absolute_path=True),
    ),
    "Decision": (
        text("decision_id"), choice("decision_type", S.DECISION_TYPES),
        choice("status", S.DECISION_STATUSES), text("subject_id"), text("summary"),
        text("rationale"), Rule("human_review_required"),
    ),
}
#: Entities written in camelCase; the others keep snake_case.
CAMEL_ENTITIES = ("Evidence", "ValidationFinding", "SkillResult")


def _violation(rule: Rule, value: str) -> str:
    """SQL that is true when the field is bad; the checks are null for a null value."""
    bad = []
    if rule.min_length is not None:
        bad.append(f"length({value}) < {rule.min_length}")
    if rule.pattern is not None:
        bad.append(f"NOT {matches_sql(value, rule.pattern)}")
    if rule.ge is not None:
        bad.append(f"{value} < {rule.ge}")
    if rule.values is not None:
        bad.append(f"{value} NOT IN ({', '.join(repr(v) for v in rule.values)})")
    if rule.absolute_path:
        bad.append(f"NOT {absolute_sql(value)}")
    if rule.required:
        bad.append(f"{value} IS NULL")
    return " OR ".join(bad) or "false"


def field_errors(
    rules: tuple[Rule, ...], at: str = "", prefix: str = "'$'", camel: bool = False,
    present: set[str] | None = None, depth: int = 0,
) -> str:
    """SQL of the array of paths of all failing fields, nested list items included.

    `at` prefixes the columns, `present` limits them to those the table has: an absent optional
    field is fine, an absent required one always fails.
    """
    flat, nested = [], []
    for rule in rules:
        path = f"{prefix} || '.{to_camel(rule.name) if camel else rule.name}'"
        missing = present is not None and rule.name not in present
        if rule.items and not missing:
            item, i = f"item{depth}", f"i{depth}"
            inner = field_errors(
                rule.items, f"{item}.", f"{path} || '.' || {i}", camel, depth=depth + 1
            )
            nested.append(
                f"coalesce(flatten(transform({at}{rule.name}, ({item}, {i}) -> {inner})), {_NO_PATHS})"
            )
        elif missing:
            flat.append(path if rule.required else "NULL")
        else:
            flat.append(f"CASE WHEN {_violation(rule, at + rule.name)} THEN {path} END")
    own = f"array_compact(array({', '.join(flat)}))"
    return f"concat({', '.join([own, *nested])})" if nested else own


_NO_PATHS = "CAST(array() AS ARRAY<STRING>)"


def row_errors(df: DataFrame, entity: str) -> Column:
    """`field_errors` of a whole row."""
    rules = {**ENTITIES, **INTERNAL}[entity]
    return F.expr(
        field_errors(rules, camel=entity in CAMEL_ENTITIES, present=set(df.columns))
    )


def with_defaults(df: DataFrame, entity: str) -> DataFrame:
    """Absent optional values replaced by their declared defaults."""
    defaults = {}
    for rule in ENTITIES[entity]:
        if rule.default is None or rule.name not in df.columns:
            continue
        if rule.default == []:
            empty = F.array().cast(df.schema[rule.name].dataType)
            defaults[rule.name] = F.coalesce(F.col(rule.name), empty)
        else:
            defaults[rule.name] = F.coalesce(F.col(rule.name), F.lit(rule.default))
    return df.withColumns(defaults)


def _first_failing(rules: dict[str, str]) -> Column:
    """Name of the first rule whose *violation* (SQL) holds, in declaration order."""
    cases = " ".join(f"WHEN {violated} THEN '{name}'" for name, violated in rules.items())
    return F.expr(f"CASE {cases} END")


def occurrence_invariant() -> Column:
    return _first_failing({"position_required": "technical_position IS NULL AND status = 'approved'"})


def provenance_invariant() -> Column:
    return _first_failing(
        {
            "approved_requires_verified": "status = 'approved' AND NOT verified",
            "absolute_path": absolute_sql("source_file"),
            "parent_segment": parent_segment_sql("source_file"),
        }
    )


def sheet_invariant() -> Column:
    """Consistency of one sheet authorization."""
    data = "classification = 'data_table'"
    model = "classification = 'model_reference'"
    approved = "coalesce(medium_confidence_approved, false)"
    return _first_failing(
        {
            "data_table_not_normalized": f"{data} AND NOT normalize",
            "data_table_without_header": f"{data} AND header_row IS NULL",
            "data_table_confidence": f"{data} AND header_confidence NOT IN ('high', 'medium')",
            "data_table_medium_unapproved":
                f"{data} AND header_confidence = 'medium' AND NOT {approved}",
            "data_table_excluded": f"{data} AND exclusion_reason_code IS NOT NULL",
            "normalized_non_table": f"NOT {data} AND normalize",
            "exclusion_without_reason":
                "classification IN ('metadata_or_readme', 'excluded_non_data') "
                "AND exclusion_reason_code IS NULL",
            "model_reference_header": f"{model} AND header_row IS NOT NULL",
            "model_reference_confidence": f"{model} AND header_confidence <> 'none'",
            "model_reference_medium_approved": f"{model} AND {approved}",
            "model_reference_excluded": f"{model} AND exclusion_reason_code IS NOT NULL",
        }
    )


def severity_invariant(bad_errors: str, bad_warnings: str) -> Column:
    """From the counts of items with the wrong severity in each list."""
    return _first_failing(
        {"errors_not_error": f"{bad_errors} > 0", "warnings_not_warning": f"{bad_warnings} > 0"}
    )


def status_invariant(errors: str, warnings: str) -> Column:
    """From the sizes of the two lists."""
    return _first_failing(
        {
            "pass_with_errors": f"status = 'PASS' AND {errors} > 0",
            "pass_with_warnings": f"status = 'PASS' AND {warnings} > 0",
            "pass_with_review": "status = 'PASS' AND human_review_required",
            "warning_with_errors": f"status = 'WARNING' AND {errors} > 0",
            "warning_without_warnings": f"status = 'WARNING' AND {warnings} = 0",
            "warning_without_review": "status = 'WARNING' AND NOT human_review_required",
            "fail_without_errors": f"status = 'FAIL' AND {errors} = 0",
            "fail_without_review": "status = 'FAIL' AND NOT human_review_required",
        }
    )


def decision_invariant(findings: str, errors: str, failed_sources: str) -> Column:
    """From the counts of findings, ERROR findings and FAIL source results."""
    return _first_failing(
        {
            "approved_with_review": "status = 'APPROVED' AND human_review_required",
            "approved_with_errors": f"status = 'APPROVED' AND {errors} > 0",
            "approved_with_failed_source": f"status = 'APPROVED' AND {failed_sources} > 0",
            "review_without_review": "status = 'REVIEW_REQUIRED' AND NOT human_review_required",
            "review_without_findings": f"status = 'REVIEW_REQUIRED' AND {findings} = 0",
            "rejected_without_review": "status = 'REJECTED' AND NOT human_review_required",
            "rejected_without_errors": f"status = 'REJECTED' AND {errors} = 0",
        }
    )


def _result_row_invariant() -> Column:
    """All result invariants on one nested result row."""
    ids = "transform(evidence, e -> e.evidence_id)"
    refs = f"flatten(transform(concat(errors, warnings), f -> coalesce(f.evidence_refs, {_NO_PATHS})))"
    return F.coalesce(
        severity_invariant(
            "size(filter(errors, f -> f.severity <> 'ERROR'))",
            "size(filter(warnings, f -> f.severity <> 'WARNING'))",
        ),
        status_invariant("size(errors)", "size(warnings)"),
        _first_failing(
            {
                "duplicate_evidence": f"size({ids}) > size(array_distinct({ids}))",
                "dangling_reference": f"size(array_except({refs}, {ids})) > 0",
            }
        ),
    )


INVARIANTS = {"ElementOccurrence": occurrence_invariant, "SkillResult": _result_row_invariant}


def validate_contract(
    df: DataFrame, entity: str, subject: str
) -> tuple[DataFrame, DataFrame]:
    """`(valid rows, findings)` of a typed table against a named entity.

    Valid rows have defaults filled and the entity's spelling; findings carry one row per bad
    field, or one at `$` for a failed invariant. Columns other than the entity's are kept.
    """
    if entity not in ENTITIES:
        raise ValueError(f"UNSUPPORTED_MODEL_NAME: expected one of {', '.join(sorted(ENTITIES))}")
    filled = with_defaults(df, entity)
    errors = row_errors(filled, entity)
    if entity in INVARIANTS:
        failed = F.when(INVARIANTS[entity]().isNotNull(), F.array(F.lit("$")))
        errors = F.when(F.size(errors) > 0, errors).otherwise(F.coalesce(failed, F.expr(_NO_PATHS)))
    judged = filled.withColumn("_errors", errors)
    valid = judged.filter(F.size("_errors") == 0).drop("_errors")
    if entity in CAMEL_ENTITIES:
        valid = alias_columns(valid)
    findings = judged.select(
        F.col(subject).alias("subject_id"), F.lit(S.ERROR).alias("severity"),
        F.lit("PAYLOAD_VALIDATION_ERROR").alias("code"), F.explode("_errors").alias("path"),
    )
    return valid, findings


# --- JSON documents -------------------------------------------------------------------------------


def forbid_extra_keys(docs: DataFrame, allowed: list[str]) -> DataFrame:
    """One finding per unknown top-level key of well-formed JSON objects."""
    keys = F.when(is_json_object(F.col("doc")), F.json_object_keys("doc"))
    extra = F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))
    return docs.select("doc_id", F.explode(extra).alias("key")).select(
        "doc_id", F.lit(S.ERROR).alias("severity"),
        F.lit("PAYLOAD_VALIDATION_ERROR").alias("code"),
        F.concat(F.lit("$."), F.col("key")).alias("path"),
    )


def json_contract_check(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Schema documents (`doc_id, schema_name, doc`) against the fixed structure contracts.

    A document is parsed once; what is no object counts as absent, and of repeated keys the last counts.
    `wanted` (`doc_id, schema_name`) lists documents that must be there; without text they are not.
    """
    last_key_counts(docs.sparkSession)
    if wanted is not None:
        docs = wanted.select("doc_id", "schema_name").join(docs, ["doc_id", "schema_name"], "left")
    trees = docs.select("doc_id", "schema_name", F.col("doc").isNotNull().alias("given"), members(parsed(F.col("doc"))).alias("root"))
    parts = trees.withColumn("defs", members(member(F.col("root"), "$defs")))
    definitions = {d for contract in S.SCHEMA_CONTRACTS.values() for d, _, _ in contract}
    for name in sorted(definitions):
        body = members(member(F.col("defs"), name))
        parts = parts.withColumn(name, F.when(body.isNotNull(), F.struct(F.map_keys(members(member(body, "properties"))).alias("names"))))
    per_schema = None
    for schema, contract in S.SCHEMA_CONTRACTS.items():
        found = []
        for name, required, forbidden in contract:
            at, there = f"$.$defs.{name}", F.col(name).isNotNull()
            names = F.coalesce(F.col(f"{name}.names"), F.array().cast("array<string>"))
            found.append(F.when(~there, _code("SCH_006", at)))
            for code, wrong, properties in (("SCH_007", False, required), ("SCH_008", True, forbidden)):
                for prop in properties:
                    found.append(F.when(there & (F.array_contains(names, prop) == wrong), _code(code, f"{at}.properties.{prop}")))
        case = F.array_compact(F.array(*found))
        matched = F.col("schema_name") == schema
        per_schema = F.when(matched, case) if per_schema is None else per_schema.when(matched, case)
    findings = (
        F.when(~F.coalesce(F.col("schema_name").isin(*S.SCHEMA_CONTRACTS), F.lit(False)), F.array(_code("SCH_002", None)))
        .when(~F.col("given"), F.array(_code("SCH_003", None)))
        .when(F.col("root").isNull(), F.array(_code("SCH_004", None)))
        .when(F.col("defs").isNull(), F.array(_code("SCH_005", "$.$defs")))
        .otherwise(per_schema)
    )
    return parts.select("doc_id", F.explode(findings).alias("f")).select(
        "doc_id", F.lit(S.ERROR).alias("severity"), "f.code", "f.path"
    )


def _code(code: str, path: str | None) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(path).cast("string").alias("path"))


def check_code_patterns(rows: DataFrame, subject: Column, patterns: dict[str, str]) -> DataFrame:
    """`subject_id, field, value, well_formed` for each column of `patterns`, tested as a whole.

    Null values have no verdict. One pass over the rows, whatever the number of fields.
    """
    tests = [
        F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("value"), matches(name, pattern).alias("well_formed"))
        for name, pattern in patterns.items()
    ]
    return rows.select(subject.alias("subject_id"), F.explode(F.array(*tests)).alias("t")).select("subject_id", "t.*")


def check_mapping_spec(columns: DataFrame) -> DataFrame:
    """Mapping specs given as column rows: the first invariant each spec breaks.

    Input `spec_id, header_row, first_data_row, source_column_ordinal, target_field`.
    """
    stats = columns.groupBy("spec_id").agg(
        F.max("header_row").alias("header_row"), F.max("first_data_row").alias("first_data_row"),
        F.count("source_column_ordinal").alias("n"),
        F.count_distinct("source_column_ordinal").alias("ordinals"),
        F.count_distinct("target_field").alias("fields"),
    )
    problem = _first_failing(
        {
            "no_columns": "n = 0",
            "data_before_header": "first_data_row <= header_row",
            "duplicate_column_ordinal": "ordinals < n",
            "duplicate_target_field": "fields < n",
        }
    )
    return stats.select(
        "spec_id", F.lit("MAPPING_SPEC_INVALID").alias("code"), problem.alias("problem")
    ).filter("problem is not null")
