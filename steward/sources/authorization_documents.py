"""Authorizations, inspection reports and output bindings from their JSON documents.

One row holds the three texts that are judged together. Each text is parsed once; its lists become tables with
a position. Authorizations and bindings are strict: unknown keys, missing or wrongly typed fields are findings, and
a field may be spelled in camel or snake case. Reports are read leniently: what isn't there is null,
and the rules that need it fail.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from steward.functions.naming import to_camel
from steward.functions.variants import doubled, fits, is_array, items, kind, last_key_counts, member, members, parsed, scalar
from steward.schemas import ERROR
from steward.sources.documents import JSON_CODES
from steward.staging import staged

ID = "authorization_id"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = True
    nullable: bool = False
    default: object = None


def _optional(name: str, of: str, default: object = None) -> Field:
    return Field(name, of, False, default is None, default)


AUTHORIZATION = (
    Field("version", "int"), Field("source_id", "string"), Field("inspection_report_id", "string"),
    Field("output_storage_class", "string"), Field("approved_output_root_id", "string"), Field("sheets", "list"),
    _optional("acknowledged_findings", "list", ()), _optional("model_reference_reviews", "list", ()),
    Field("human_review_completed", "boolean"),
)
SHEET = (
    Field("sheet_ordinal", "int"), Field("classification", "string"), Field("normalize", "boolean"), _optional("header_row", "int"),
    Field("header_confidence", "string"), _optional("medium_confidence_approved", "boolean", False), _optional("exclusion_reason_code", "string"),
)
ACKNOWLEDGEMENT = (
    Field("code", "string"), _optional("sheet_ordinal", "int"), Field("disposition", "string"), Field("reason_code", "string"),
)
REVIEW = (
    Field("sheet_ordinal", "int"), Field("drawing_review_category", "string"), Field("completed", "boolean"),
    *(_optional(name, "boolean", False) for name in (
        "reference_model_alignment_approved", "model_reference_scope_approved", "model_reference_reviewer_recorded")),
    _optional("evidence_reference_id", "string"),
    *(_optional(name, "boolean", False) for name in ("external_verification_asserted", "external_verification_technically_confirmed")),
)
BINDING = (Field("version", "int"), Field("root_id", "string"), Field("storage_class", "string"), Field("root_path", "string"))


def _raw(of: str, field: Field) -> Column:
    """A field by either spelling; of two, the camel-case one counts."""
    camel, snake = member(F.col(of), to_camel(field.name)), member(F.col(of), field.name)
    return camel if to_camel(field.name) == field.name else F.coalesce(camel, snake)


def _opened(of: str, fields: tuple[Field, ...]) -> list[Column]:
    """The raw fields, each looked up once."""
    return [_raw(of, f).alias(f"raw_{f.name}") for f in fields]


def _kinds(fields: tuple[Field, ...]) -> list[Column]:
    return [kind(F.col(f"raw_{f.name}")).alias(f"kind_{f.name}") for f in fields if f.kind != "list"]


def _value(field: Field) -> Column:
    value = scalar(F.col(f"raw_{field.name}"), field.kind, F.col(f"kind_{field.name}"))
    return F.coalesce(value, F.lit(field.default)) if field.default is not None else value


def _problems(of: str, fields: tuple[Field, ...]) -> Column:
    """Names of unknown keys and of fields that are missing or of a wrong type; null stands for an object that is none."""
    found = []
    for field in fields:
        raw = F.col(f"raw_{field.name}")
        null = F.is_variant_null(raw)
        right = is_array(raw) if field.kind == "list" else fits(raw, field.kind, F.col(f"kind_{field.name}"))
        wrong = F.when(raw.isNull(), F.lit(field.required)).when(null, F.lit(not field.nullable)).otherwise(~F.coalesce(right, F.lit(False)))
        found.append(F.when(wrong, F.lit(to_camel(field.name))))
    known = [F.lit(n) for field in fields for n in {to_camel(field.name), field.name}]
    both = [F.when(member(F.col(of), to_camel(f.name)).isNotNull() & member(F.col(of), f.name).isNotNull(), F.lit(f.name))
            for f in fields if to_camel(f.name) != f.name]
    extra = F.array_except(F.map_keys(of), F.array(*known))
    return F.when(F.col(of).isNotNull(), F.concat(F.array_compact(F.array(*found, *both)), extra))


def _without(of: str, lists: tuple[str, ...]) -> Column:
    """The members of an object with its lists emptied: they are kept beside it, and read only by those who need them."""
    empty = F.parse_json(F.lit("[]"))
    return F.transform_values(of, lambda name, value: F.when(name.isin(*lists) & is_array(value), empty).otherwise(value))


@dataclass(frozen=True)
class AuthorizationDocuments:
    """The tables `operators.authorize` takes, in its order of arguments, and what was wrong with the documents."""

    authorizations: DataFrame
    auth_sheets: DataFrame
    acks: DataFrame
    reviews: DataFrame
    reports: DataFrame
    report_sheets: DataFrame
    report_findings: DataFrame
    output_bindings: DataFrame
    findings: DataFrame

    def tables(self) -> list[DataFrame]:
        return [self.authorizations, self.auth_sheets, self.acks, self.reviews, self.reports, self.report_sheets,
                self.report_findings, self.output_bindings]


def read_authorization_documents(docs: DataFrame) -> AuthorizationDocuments:
    """Tables and findings of `authorization_id, authorization, report, binding, output_dir` (texts) rows.

    `findings` has `authorization_id, severity, code, path, field`. A text that is no JSON object is one finding and
    has no rows in any table. A field of a wrong shape is a finding and null in its table.
    """
    last_key_counts(docs.sparkSession)
    names = ("authorization", "report", "binding")
    lists_of = {"authorization": [f.name for f in AUTHORIZATION if f.kind == "list"], "report": ["sheets", "findings"], "binding": []}
    texts = docs.select("*", *[doubled(F.col(name)).alias(f"both_{name}") for name in names])
    whole = texts.select(ID, "output_dir", F.col("report").alias("report_text"),
                         *[members(parsed(F.col(name), F.col(f"both_{name}"))).alias(name) for name in names])
    # Each list has a column of its own in the staged table, so that whoever reads one reads nothing else.
    trees = staged(whole.select(
        ID, "output_dir", "report_text",
        *[F.struct(_without(name, tuple(n for f in lists_of[name] for n in {f, to_camel(f)})).alias("m"),
                   *[items(_raw(name, Field(f, "list"))).alias(f) for f in lists_of[name]]).alias(name) for name in names],
    ), "trees")

    invalid = F.array(*[
        F.when(F.col(f"{name}.m").isNull(), F.struct(F.lit(code).alias("code"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("field")))
        for name, code in (("report", JSON_CODES["report"]), ("authorization", JSON_CODES["authorization"]), ("binding", JSON_CODES["binding"]))
    ])
    found = [trees.select(ID, F.explode(F.array_compact(invalid)).alias("f")).select(ID, "f.*")]

    def shaped(rows: DataFrame, of: str, fields: tuple[Field, ...], code: str, path: Column, *keep: str) -> DataFrame:
        opened = rows.select("*", *_opened(of, fields)).select("*", *_kinds(fields))
        problems = F.coalesce(_problems(of, fields), F.array(F.lit(None).cast("string")))
        found.append(opened.select(ID, F.lit(code).alias("code"), path.alias("path"), F.explode(problems).alias("field")))
        return opened.select(ID, *keep, *[_value(f).alias(f.name) for f in fields if f.kind != "list"])

    def listed(rows: DataFrame, of: str, position: str) -> DataFrame:
        return rows.select(ID, F.posexplode(of).alias(position, "v")).select(
            ID, F.col(position).cast("bigint").alias(position), members(F.col("v")).alias("m"))

    contract = "AUTHORIZATION_INVALID"
    objects = trees.filter("authorization.m IS NOT NULL").select(ID, F.col("authorization.m").alias("m"))
    root = shaped(objects, "m", AUTHORIZATION, contract, F.lit("$.authorization"))
    lists = {}
    for name, fields, position in (("sheets", SHEET, "sheet_index"), ("acknowledged_findings", ACKNOWLEDGEMENT, "ack_index"),
                                   ("model_reference_reviews", REVIEW, "review_index")):
        path = F.concat(F.lit(f"$.authorization.{to_camel(name)}."), F.col(position))
        one = trees.select(ID, F.col(f"authorization.{name}").alias("v"))
        lists[name] = shaped(listed(one, "v", position), "m", fields, contract, path, position)
    bindings = trees.filter("binding.m IS NOT NULL").select(ID, "output_dir", F.col("binding.m").alias("m"))
    binding = shaped(bindings, "m", BINDING, "OUTPUT_ROOT_BINDING_INVALID", F.lit("$.binding"), "output_dir")

    reports = trees.filter("report.m IS NOT NULL").select(ID, "report_text", F.col("report.m").alias("m"))
    summary = members(member(F.col("m"), "summary"))

    def flag(raw: Column) -> Column:
        return F.coalesce(scalar(raw, "boolean"), F.lit(False))

    report = reports.select(
        ID, scalar(member(F.col("m"), "reportVersion"), "json int").alias("report_version"),
        flag(member(F.col("m"), "provenanceVerified")).alias("provenance_verified"),
        scalar(member(F.col("m"), "manifestStatus"), "string").alias("manifest_status"),
        scalar(member(F.col("m"), "inspectionMode"), "string").alias("inspection_mode"),
        flag(member(summary, "inspectionCompleted")).alias("inspection_completed"),
        scalar(member(F.col("m"), "sourceId"), "string").alias("source_id"), "report_text")

    def number(of: str) -> Column:
        return scalar(member(F.col("m"), of), "json int")

    def of_report(name: str, position: str) -> DataFrame:
        return listed(trees.select(ID, F.col(f"report.{name}").alias("v")), "v", position)

    sheets = of_report("sheets", "sheet_index").select(
        ID, "sheet_index", number("sheetOrdinal").alias("sheet_ordinal"), number("inferredHeaderRow").alias("inferred_header_row"),
        scalar(member(F.col("m"), "headerConfidence"), "string").alias("header_confidence"))
    raised = of_report("findings", "finding_index")
    found.append(raised.filter("m IS NULL").select(
        ID, F.lit("REPORT_NOT_OBJECT").alias("code"), F.lit("$.report").alias("path"), F.lit(None).cast("string").alias("field")))
    report_findings = raised.filter("m IS NOT NULL").select(
        ID, "finding_index", *[scalar(member(F.col("m"), name), "string").alias(name) for name in ("severity", "code", "path")])
    findings = found[0]
    for more in found[1:]:
        findings = findings.unionByName(more)
    return AuthorizationDocuments(
        root, lists["sheets"],
        lists["acknowledged_findings"].drop("ack_index"), lists["model_reference_reviews"].drop("review_index"),
        report, sheets, report_findings, binding,
        findings.select(ID, F.lit(ERROR).alias("severity"), "code", "path", "field"))
