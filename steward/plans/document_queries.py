"""Queries over JSON documents that hold authorizations, reports and bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from steward.functions.naming import alias_columns
from steward.operators import authorize as az
from steward.plans.authorization_queries import _STEPS as _AUTH_STEPS
from steward.plans.bindings import bind
from steward.plans.registry import query
from steward.session import spread
from steward.sources.authorization_documents import ID, read_authorization_documents
from steward.staging import staged


def _gathered(rows: DataFrame, name: str, order: str, *columns: str) -> DataFrame:
    """A report's or authorization's rows as one list; a report has a few dozen."""
    members = F.array_sort(F.collect_list(F.struct(order, F.struct(*columns).alias("v")))) if order else None
    listed = F.collect_list(F.struct(*columns)) if members is None else F.transform(members, lambda m: m["v"])
    return rows.groupBy(ID).agg(listed.alias(name))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """`authorization_id, r, authorization, report, binding, output_dir`: the tables rendered as texts.

    Odd authorizations are spelled in snake case. The identity of a report follows its new text.
    """
    reports = spread(bind(spark, sf, "reports"), ID)
    sheets = _gathered(bind(spark, sf, "report_sheets"), "sheets", "sheet_index", "sheet_ordinal", "inferred_header_row", "header_confidence")
    found = _gathered(bind(spark, sf, "report_findings"), "findings", "finding_index", "severity", "code", "path")
    whole = alias_columns(
        reports.join(sheets, ID, "left").join(found, ID, "left").withColumn("summary", F.struct("inspection_completed"))
        .drop("inspection_completed"))
    fields = ("reportVersion", "provenanceVerified", "manifestStatus", "inspectionMode", "summary", "sourceId", "sheets", "findings")
    texts = whole.select(
        F.col("authorizationId").alias(ID), F.col("reportText").alias("old"), F.to_json(F.struct(*fields)).alias("report"))

    auth = bind(spark, sf, "authorizations").join(texts, ID)
    old, new, named = F.sha2("old", 256), F.sha2("report", 256), F.col("inspection_report_id")
    auth = auth.withColumn("inspection_report_id", F.when(named == old, new).when(named == F.upper(old), F.upper(new)).otherwise(named))
    lists = (
        ("auth_sheets", "sheets", "sheet_index", ("sheet_ordinal", "classification", "normalize", "header_row", "header_confidence",
                                                  "medium_confidence_approved", "exclusion_reason_code")),
        ("acks", "acknowledged_findings", None, ("code", "sheet_ordinal", "disposition", "reason_code")),
        ("reviews", "model_reference_reviews", None, (
            "sheet_ordinal", "drawing_review_category", "completed", "reference_model_alignment_approved", "model_reference_scope_approved",
            "model_reference_reviewer_recorded", "evidence_reference_id", "external_verification_asserted",
            "external_verification_technically_confirmed")),
    )
    for source, name, order, columns in lists:
        auth = auth.join(_gathered(bind(spark, sf, source), name, order, *columns), ID, "left")
    own = ("version", "source_id", "inspection_report_id", "output_storage_class", "approved_output_root_id", "human_review_completed",
           "sheets", "acknowledged_findings", "model_reference_reviews")
    body = auth.select(*own)
    camel = F.to_json(F.struct(*own).cast(alias_columns(body).schema))
    text = F.when(F.col("r") % 2 == 0, camel).otherwise(F.to_json(F.struct(*own)))
    bindings = bind(spark, sf, "output_bindings").select(
        ID, F.to_json(F.struct("version", F.col("root_id").alias("rootId"), F.col("storage_class").alias("storageClass"),
                               F.col("root_path").alias("rootPath"))).alias("binding"), "output_dir")
    return auth.select(ID, "r", text.alias("authorization"), "report").join(bindings, ID)


@query(oracle="select * from verdicts_by_authorization", **_AUTH_STEPS)
def q_document_verdict(spark, sf):
    read = read_authorization_documents(documents(spark, sf))
    tables = dict(zip(("authorizations", "auth_sheets", "acks", "reviews", "reports", "report_sheets", "report_findings", "output_bindings"),
                      read.tables(), strict=True))
    return az.authorization_verdict(*[
        staged(t, name) if name in ("auth_sheets", "acks", "reviews", "report_findings") else t for name, t in tables.items()])


_ODD_SHEET = ',"sheets":[{"sheetOrdinal":true,"classification":"data_table","normalize":1,"headerConfidence":"high","headerRow":1.5}]'


@query(
    oracle="""
select authorization_id, 'ERROR' as severity, code, path, field
from (select authorization_id, cast(r % 11 as int) as k from authorizations) a join (values
  (1, 'AUTHORIZATION_JSON_INVALID', '$', null), (2, 'OUTPUT_ROOT_BINDING_JSON_INVALID', '$', null),
  (3, 'INSPECTION_REPORT_INVALID', '$', null), (4, 'AUTHORIZATION_INVALID', '$.authorization', 'colour'),
  (6, 'AUTHORIZATION_INVALID', '$.authorization', 'version'), (7, 'OUTPUT_ROOT_BINDING_INVALID', '$.binding', 'rootPath'),
  (8, 'REPORT_NOT_OBJECT', '$.report', null), (9, 'AUTHORIZATION_INVALID', '$.authorization.sheets.0', 'sheetOrdinal'),
  (9, 'AUTHORIZATION_INVALID', '$.authorization.sheets.0', 'normalize'), (9, 'AUTHORIZATION_INVALID', '$.authorization.sheets.0', 'headerRow')
) f(of_fault, code, path, field) on k = of_fault
""",
    **_AUTH_STEPS,
)
def q_document_findings(spark, sf):
    fault = F.col("r") % 11
    text = F.col("authorization")
    last = lambda column, more: F.concat(F.expr(f"substr({column}, 1, length({column}) - 1)"), F.lit(more + "}"))
    docs = documents(spark, sf).select(
        ID, "output_dir",
        F.when(fault == 1, F.expr("substr(authorization, 1, length(authorization) - 1)"))
        .when(fault == 4, F.concat(F.lit('{"colour":1,'), F.expr("substr(authorization, 2)")))
        .when(fault == 5, F.concat(F.lit('{"version":"1",'), F.expr("substr(authorization, 2)")))  # the later one counts
        .when(fault == 6, last("authorization", ',"version":"1"'))
        .when(fault == 9, last("authorization", _ODD_SHEET)).otherwise(text).alias("authorization"),
        F.when(fault == 3, F.concat("report", F.lit("x"))).when(fault == 8, last("report", ',"findings":[1,{}]'))
        .otherwise(F.col("report")).alias("report"),
        F.when(fault == 2, F.concat(F.lit("["), "binding", F.lit("]")))
        .when(fault == 7, F.lit('{"version":1,"root_id":"ROOT-A","storageClass":"internal-restricted"}'))
        .otherwise(F.col("binding")).alias("binding"),
    )
    return read_authorization_documents(docs).findings
