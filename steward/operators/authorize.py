"""Reviewed authorizations against inspection reports.

Every table is keyed by `authorization_id`, so one job judges all authorizations. Two ledgers
replace a chain of outer joins: all sources of sheet facts (report sheets, authorized sheets,
drawing reviews, empty/drawing findings) are unioned and grouped once by (authorization, sheet
ordinal), and report findings with acknowledgements once by (authorization, code, ordinal).
Grouping keeps the first report row by position, treats a null ordinal as a value, and cannot
multiply rows however often a key repeats.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from steward.functions.paths import lies_under_sql, sheet_ordinal_from_path
from steward.operators import contracts
from steward import schemas as S
from steward.session import spread
from steward.staging import staged

KEY = ["authorization_id"]
SHEET_KEY = ["authorization_id", "sheet_ordinal"]
FINDING_KEY = ["authorization_id", "code", "sheet_ordinal"]
SHEETS_PATH, ACKS_PATH = "$.authorization.sheets", "$.authorization.acknowledgedFindings"
REVIEWS_PATH, FINDINGS_PATH = "$.authorization.modelReferenceReviews", "$.report.findings"

_SHEET_FACTS = {
    "r": "struct<sheet_index:bigint,inferred_header_row:int,header_confidence:string>",
    "a": "struct<classification:string,normalize:boolean,header_row:int,header_confidence:string>",
    "v": "struct<category:string,completed:boolean,alignment:boolean,scope:boolean,"
         "reviewer:boolean,evidence:boolean>",
    "is_empty": "boolean",
    "is_drawing": "boolean",
    "is_bad": "boolean",
}


def _facts(df: DataFrame, keys: list[str], columns: dict[str, str], **given: Column) -> DataFrame:
    """Rows of one source shaped for the union: the other sources' columns are null."""
    return df.select(
        *keys,
        *[(given[n] if n in given else F.lit(None)).cast(t).alias(n) for n, t in columns.items()],
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- ledgers --------------------------------------------------------------------------------------


def sheet_ledger(
    report_sheets: DataFrame | None = None,
    auth_sheets: DataFrame | None = None,
    report_findings: DataFrame | None = None,
    reviews: DataFrame | None = None,
) -> DataFrame:
    """One row per (authorization, sheet ordinal) with what each side says about it.

    `r` the report's sheet (first occurrence), `a` the authorized sheet, `v` the drawing review,
    `is_empty`/`is_drawing` whether the report calls the sheet so; null where a side is silent.
    Report rows whose ordinal is no sheet at all are only counted, in `bad_rows`.
    """
    parts = []
    if report_sheets is not None:
        usable = F.expr("coalesce(sheet_ordinal >= 0, false)")
        fact = F.struct("sheet_index", "inferred_header_row", "header_confidence")
        parts.append(
            _facts(report_sheets, SHEET_KEY, _SHEET_FACTS, r=F.when(usable, fact), is_bad=~usable)
        )
    if auth_sheets is not None:
        fact = F.struct("classification", "normalize", "header_row", "header_confidence")
        parts.append(_facts(auth_sheets, SHEET_KEY, _SHEET_FACTS, a=fact))
    if reviews is not None:
        evidence = (
            F.col("evidence_reference_id").isNotNull()
            & F.col("external_verification_asserted")
            & ~F.col("external_verification_technically_confirmed")
        )
        fact = F.struct(
            F.col("drawing_review_category").alias("category"), "completed",
            F.col("reference_model_alignment_approved").alias("alignment"),
            F.col("model_reference_scope_approved").alias("scope"),
            F.col("model_reference_reviewer_recorded").alias("reviewer"),
            evidence.alias("evidence"),
        )
        parts.append(_facts(reviews, SHEET_KEY, _SHEET_FACTS, v=fact))
    if report_findings is not None:
        keyed = report_findings.filter(
            F.col("code").isin(S.EMPTY_SHEET, S.DRAWING_ONLY_SHEET)
        ).withColumn("sheet_ordinal", sheet_ordinal_from_path(F.col("path")))
        parts.append(
            _facts(
                keyed.filter("sheet_ordinal is not null"), SHEET_KEY, _SHEET_FACTS,
                is_empty=F.col("code") == S.EMPTY_SHEET,
                is_drawing=F.col("code") == S.DRAWING_ONLY_SHEET,
            )
        )
    return _union(parts).groupBy(*SHEET_KEY).agg(
        F.min("r").alias("r"), F.max("a").alias("a"), F.max("v").alias("v"),
        F.coalesce(F.bool_or("is_empty"), F.lit(False)).alias("is_empty"),
        F.coalesce(F.bool_or("is_drawing"), F.lit(False)).alias("is_drawing"),
        F.count("r").alias("report_rows"), F.expr("count_if(is_bad) AS bad_rows"),
    )


#: Facts as numbers, so that the grouping hashes with fixed-width buffers instead of sorting:
#: `f` is twice the position of the finding, plus one unless it is an ERROR; `k` the disposition,
#: stricter ones higher, so that of repeated acknowledgements the strictest counts.
_FINDING_FACTS = {"f": "bigint", "k": "int"}
_ACCEPTED = 0
_DISPOSITION = {"accepted_for_reviewed_scope": _ACCEPTED, "resolved": 1, "remains_blocking": 2}


def finding_ledger(report_findings: DataFrame, acks: DataFrame) -> DataFrame:
    """One row per (authorization, code, sheet ordinal): the report's first finding `f`, how
    often it is reported, and its acknowledgement `k`; null where a side is silent."""
    first = F.expr("finding_index * 2 + IF(severity <=> 'ERROR', 0, 1)")
    known = " ".join(f"WHEN '{name}' THEN {i}" for name, i in _DISPOSITION.items())
    # An unknown disposition fails the contract; here it only must not look like an acceptance.
    acknowledged = F.expr(f"CASE disposition {known} ELSE {len(_DISPOSITION)} END")
    keyed = report_findings.withColumn("sheet_ordinal", sheet_ordinal_from_path(F.col("path")))
    parts = [
        _facts(keyed, FINDING_KEY, _FINDING_FACTS, f=first),
        _facts(acks, FINDING_KEY, _FINDING_FACTS, k=acknowledged),
    ]
    # Nearly every key is another one: grouping before the shuffle would hold a task's whole input and spare little of it.
    return spread(_union(parts), *FINDING_KEY).groupBy(*FINDING_KEY).agg(
        F.min("f").alias("f"), F.max("k").alias("k"), F.count("f").alias("report_rows")
    )


# --- per-sheet rules ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """One finding where a condition holds, all as SQL."""

    condition: str
    code: str
    path: str
    occurrences: str

    def finding(self) -> str:
        body = f"named_struct('code', {self.code}, 'path', {self.path}, 'occurrences', CAST({self.occurrences} AS BIGINT))"
        return f"CASE WHEN {self.condition} THEN {body} END"

    def count(self) -> str:
        return f"CASE WHEN {self.condition} THEN CAST({self.occurrences} AS BIGINT) ELSE 0L END"


def _rule(condition: str, code: str, path: str, occurrences: str = "1") -> Rule:
    """`path` is SQL or a `$` literal."""
    return Rule(condition, repr(code), f"'{path}'" if path.startswith("$") else path, occurrences)


def _found(rules: list[Rule]) -> Column:
    return F.expr(f"array_compact(array({', '.join(r.finding() for r in rules)}))")


_AT_SHEET = "'$.authorization.sheets.' || sheet_ordinal"
_IN_REPORT, _AUTHORIZED = "r IS NOT NULL", "a IS NOT NULL"


def _coverage_rules() -> list[Rule]:
    return [
        _rule(f"{_IN_REPORT} AND a IS NULL", "SHEET_AUTHORIZATION_MISSING", SHEETS_PATH),
        _rule(f"{_AUTHORIZED} AND r IS NULL", "SHEET_AUTHORIZATION_EXTRA", SHEETS_PATH),
    ]


def _header_rules() -> list[Rule]:
    both = f"{_IN_REPORT} AND a.classification = 'data_table'"
    return [
        _rule(f"{both} AND NOT (r.inferred_header_row <=> a.header_row)",
              "HEADER_ROW_MISMATCH", f"{_AT_SHEET} || '.headerRow'"),
        _rule(f"{both} AND NOT (r.header_confidence <=> a.header_confidence)",
              "HEADER_CONFIDENCE_MISMATCH", f"{_AT_SHEET} || '.headerConfidence'"),
    ]


def _non_tabular_rules() -> list[Rule]:
    flags = {S.EMPTY_SHEET: "is_empty", S.DRAWING_ONLY_SHEET: "is_drawing"}
    return [
        _rule(f"{flags[found]} AND a.classification NOT IN {allowed}", code, _AT_SHEET)
        for found, (allowed, code) in S.NON_TABULAR_POLICY.items()
    ]


def _model_reference_rules() -> list[Rule]:
    invalid, required = "MODEL_REFERENCE_CLASSIFICATION_INVALID", "MODEL_REFERENCE_REVIEW_REQUIRED"
    model = "a.classification = 'model_reference'"
    reviewed = f"{model} AND is_drawing AND v IS NOT NULL"
    judged = f"{reviewed} AND v.category = '{S.MODEL_REFERENCE_CATEGORY}'"
    return [
        _rule("v IS NOT NULL AND NOT is_drawing", invalid, REVIEWS_PATH),
        _rule(f"{model} AND NOT is_drawing", invalid, _AT_SHEET),
        _rule(f"{model} AND is_drawing AND v IS NULL", required, _AT_SHEET),
        _rule(f"{reviewed} AND v.category <> '{S.MODEL_REFERENCE_CATEGORY}'", invalid, _AT_SHEET),
        _rule(f"{judged} AND NOT v.completed", required, _AT_SHEET),
        _rule(f"{judged} AND NOT v.alignment", "REFERENCE_MODEL_ALIGNMENT_NOT_APPROVED", _AT_SHEET),
        _rule(f"{judged} AND NOT v.scope", "MODEL_REFERENCE_SCOPE_NOT_APPROVED", _AT_SHEET),
        _rule(f"{judged} AND NOT v.reviewer", "MODEL_REFERENCE_REVIEWER_NOT_RECORDED", _AT_SHEET),
        _rule(f"{judged} AND NOT v.evidence", "MODEL_REFERENCE_REVIEW_EVIDENCE_NOT_VERIFIED", _AT_SHEET),
    ]


def _resolution_rules() -> list[Rule]:
    resolves = " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in S.DRAWING_RESOLUTIONS.items())
    resolved = f"coalesce(v.completed AND CASE v.category {resolves} END = a.classification, false)"
    open_ = f"is_drawing AND a.classification IN {tuple(S.DRAWING_RESOLUTIONS.values())}"
    return [
        _rule(f"{open_} AND NOT {resolved}",
              "MODEL_REFERENCE_AUTHORIZATION_CLASSIFICATION_UNRESOLVED", _AT_SHEET)
    ]


def _explode_rules(ledger: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    return ledger.select(*keys, F.explode(_found(rules)).alias("_f")).select(
        *keys, F.lit(S.ERROR).alias("severity"), "_f.code", "_f.path"
    )


def sheet_coverage(report_sheets: DataFrame, auth_sheets: DataFrame) -> DataFrame:
    """Sheets only one side knows."""
    return _explode_rules(sheet_ledger(report_sheets, auth_sheets), _coverage_rules(), SHEET_KEY)


def sheet_coverage_flag(report_sheets: DataFrame, auth_sheets: DataFrame) -> DataFrame:
    ledger = sheet_ledger(report_sheets, auth_sheets)
    return ledger.groupBy(*KEY).agg(_coverage_flag().alias("sheet_coverage_complete"))


def _coverage_flag() -> Column:
    known = f"({_IN_REPORT}) OR ({_AUTHORIZED})"
    return F.expr(
        f"coalesce(bool_and({_IN_REPORT} AND {_AUTHORIZED}) FILTER (WHERE {known}), false)"
    )


def header_match(report_sheets: DataFrame, auth_sheets: DataFrame) -> DataFrame:
    return _explode_rules(sheet_ledger(report_sheets, auth_sheets), _header_rules(), SHEET_KEY)


def non_tabular_policy(report_findings: DataFrame, auth_sheets: DataFrame) -> DataFrame:
    ledger = sheet_ledger(auth_sheets=auth_sheets, report_findings=report_findings)
    return _explode_rules(ledger, _non_tabular_rules(), SHEET_KEY)


def model_reference_review(
    report_findings: DataFrame, auth_sheets: DataFrame, reviews: DataFrame
) -> DataFrame:
    ledger = sheet_ledger(None, auth_sheets, report_findings, reviews)
    return _explode_rules(ledger, _model_reference_rules(), SHEET_KEY)


def drawing_resolution(
    report_findings: DataFrame, auth_sheets: DataFrame, reviews: DataFrame
) -> DataFrame:
    ledger = sheet_ledger(None, auth_sheets, report_findings, reviews)
    return _explode_rules(ledger, _resolution_rules(), SHEET_KEY)


# --- per-finding rules ----------------------------------------------------------------------------


def _verdict() -> Column:
    """The one verdict of a reported finding, by priority; null for a stale acknowledgement."""
    return F.expr(
        f"""
        CASE WHEN f IS NULL THEN NULL
             WHEN f % 2 = 0 THEN 'FATAL_FINDING_PRESENT'
             WHEN code IN {S.BLOCKING_CODES} THEN 'CURRENT_REPORT_BLOCKING_FINDING'
             WHEN k IS NULL THEN 'FINDING_AUTHORIZATION_MISSING'
             WHEN code NOT IN {S.REVIEWABLE_CODES} THEN 'UNKNOWN_FINDING_BLOCKING'
             WHEN k = {_ACCEPTED} THEN 'REVIEWED'
             ELSE 'BLOCKING_FINDING_UNRESOLVED' END
        """
    )


def _finding_rules() -> list[Rule]:
    report_side = "verdict IN ('FATAL_FINDING_PRESENT', 'CURRENT_REPORT_BLOCKING_FINDING')"
    path = f"CASE WHEN {report_side} THEN '{FINDINGS_PATH}' ELSE '{ACKS_PATH}' END"
    return [
        Rule("verdict <> 'REVIEWED'", "verdict", path, "1"),
        _rule("f IS NULL", "FINDING_AUTHORIZATION_STALE", ACKS_PATH),
        _rule("report_rows > 1", "REPORT_FINDING_DUPLICATE", FINDINGS_PATH, "report_rows - 1"),
    ]


def finding_acks(report_findings: DataFrame, acks: DataFrame) -> DataFrame:
    """Every distinct report finding with its acknowledgement, if any."""
    ledger = finding_ledger(report_findings, acks).filter(F.col("f").isNotNull())
    names = " ".join(f"WHEN {i} THEN '{name}'" for name, i in _DISPOSITION.items())
    return ledger.select(
        *FINDING_KEY, F.expr("IF(f % 2 = 0, 'ERROR', 'WARNING') AS severity"),
        F.expr(f"CASE k {names} END AS disposition"),
        F.when(F.col("k").isNull(), "FINDING_AUTHORIZATION_MISSING").alias("missing"),
    )


def stale_acks(report_findings: DataFrame, acks: DataFrame) -> DataFrame:
    """Acknowledgements of findings the report no longer has."""
    return finding_ledger(report_findings, acks).filter("f IS NULL").select(
        *FINDING_KEY, F.lit("FINDING_AUTHORIZATION_STALE").alias("finding_code")
    )


def classify_findings(report_findings: DataFrame, acks: DataFrame) -> DataFrame:
    """One verdict per distinct report finding, with the counters it feeds."""
    judged = finding_ledger(report_findings, acks).withColumn("verdict", _verdict())
    return judged.filter("verdict is not null").select(
        *FINDING_KEY, "verdict", (F.col("verdict") != "REVIEWED").alias("blocking")
    )


def finding_coverage(
    authorizations: DataFrame, report_findings: DataFrame, acks: DataFrame
) -> DataFrame:
    """Whether both key sets agree; trivially true when both are empty."""
    agrees = F.col("f").isNotNull() & F.col("k").isNotNull()
    flags = finding_ledger(report_findings, acks).groupBy(*KEY).agg(F.bool_and(agrees).alias("c"))
    return authorizations.select(*KEY).join(flags, KEY, "left").select(
        *KEY, F.coalesce(F.col("c"), F.lit(True)).alias("finding_coverage_complete")
    )


# --- per-authorization rules ------------------------------------------------------------------------


def report_identity(authorizations: DataFrame, reports: DataFrame) -> DataFrame:
    """Does the authorization name the digest of the report's raw bytes?"""
    digest = reports.select(*KEY, F.sha2(F.col("report_text"), 256).alias("_id"))
    return authorizations.join(digest, KEY).select(
        *KEY, (F.col("inspection_report_id") == F.col("_id")).alias("report_identity_matched")
    )


def _precondition() -> Column:
    verified = (
        F.col("provenance_verified") & (F.col("manifest_status") == "verified")
        & (F.col("inspection_mode") == "verified-source") & F.col("inspection_completed")
    )
    return F.when(
        ~F.col("report_version").eqNullSafe(F.lit(S.SUPPORTED_REPORT_VERSION)),
        "REPORT_VERSION_UNSUPPORTED",
    ).when(~F.coalesce(verified, F.lit(False)), "REPORT_NOT_VERIFIED")


def report_preconditions(reports: DataFrame) -> DataFrame:
    """The code that stops all later checks of a report, if any."""
    return reports.select(*KEY, _precondition().alias("code")).filter("code is not null")


def output_root_check(authorizations: DataFrame, bindings: DataFrame) -> DataFrame:
    """Findings about the output binding: contract errors, else id and location."""
    joined = authorizations.select(*KEY, "approved_output_root_id").join(
        _judged_bindings(bindings), KEY
    )
    return _explode_rules(joined, _output_rules(), KEY)


def _judged_bindings(bindings: DataFrame) -> DataFrame:
    errors = F.size(contracts.row_errors(bindings, "OutputRootBinding"))
    return bindings.select(*KEY, "root_id", "root_path", "output_dir", errors.alias("_errors"))


def _output_rules() -> list[Rule]:
    inside = lies_under_sql("output_dir", "root_path")
    return [
        _rule("_errors > 0", "OUTPUT_ROOT_BINDING_INVALID", "$.binding"),
        _rule("_errors = 0 AND root_id <> approved_output_root_id",
              "OUTPUT_ROOT_ID_MISMATCH", "$.binding.rootId"),
        _rule(f"_errors = 0 AND NOT {inside}", "OUTPUT_DIR_OUTSIDE_APPROVED_ROOT", "$.outputDir"),
    ]


def check_sheet_authorization(auth_sheets: DataFrame) -> DataFrame:
    """First broken rule of every inconsistent sheet authorization without field errors."""
    errors = contracts.row_errors(auth_sheets, "SheetAuthorization")
    judged = auth_sheets.select(
        *KEY, "sheet_index", "sheet_ordinal",
        F.when(F.size(errors) == 0, contracts.sheet_invariant()).alias("problem"),
    )
    return judged.filter("problem is not null")


def authorization_contract(
    authorizations: DataFrame, auth_sheets: DataFrame, acks: DataFrame, reviews: DataFrame
) -> DataFrame:
    """Number of contract errors per authorization, 0 when it can be used; has it a target sheet?

    Field errors and broken sheet rules of all children count. Repeated keys are looked at only
    when there are none, and then count as one error.
    """
    sheet_bad = F.size(contracts.row_errors(auth_sheets, "SheetAuthorization"))
    sheet_errors = F.when(sheet_bad > 0, sheet_bad).when(contracts.sheet_invariant().isNotNull(), 1)

    def shaped(df: DataFrame, kind: str, errors: Column, code="NULL", ordinal="NULL", target="false"):
        return df.select(
            *KEY, F.lit(kind).alias("kind"),
            F.expr(f"CAST({code} AS STRING) AS item_code"),
            F.expr(f"CAST({ordinal} AS INT) AS sheet_ordinal"),
            errors.cast("bigint").alias("errors"), F.expr(f"{target} AS target"),
        )

    def bad(df: DataFrame, entity: str) -> Column:
        return F.size(contracts.row_errors(df, entity))

    at, target = "sheet_ordinal", "coalesce(classification = 'data_table' AND normalize, false)"
    rows = _union(
        [
            shaped(authorizations, "header", bad(authorizations, "NormalizationAuthorization")),
            shaped(auth_sheets, "sheet", sheet_errors, ordinal=at, target=target),
            shaped(acks, "ack", bad(acks, "FindingAuthorization"), "code", at),
            shaped(reviews, "review", bad(reviews, "ModelReferenceReview"), ordinal=at),
        ]
    )
    keys = rows.groupBy(*KEY, "kind", "item_code", "sheet_ordinal").agg(
        F.sum("errors").alias("errors"), F.count(F.lit(1)).alias("n"),
        F.bool_or("target").alias("target"),
    )
    totals = keys.groupBy(*KEY).agg(
        F.expr("coalesce(sum(errors), 0) + IF(bool_or(kind = 'sheet'), 0, 1) AS errors"),
        F.expr("bool_or(n > 1) AS repeated"),
        F.expr("bool_or(kind = 'header') AS has_header"),
        F.bool_or("target").alias("has_target"),
    )
    return totals.filter("has_header").select(
        *KEY,
        F.expr("CASE WHEN errors > 0 THEN errors WHEN repeated THEN 1L ELSE 0L END AS contract_errors"),
        "has_target",
    )


def authorized_ordinals(auth_sheets: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Sheets to normalize, one row each; with verdicts only those of valid authorizations."""
    targets = auth_sheets.filter(
        (F.col("classification") == "data_table") & F.col("normalize")
    ).select(*KEY, "sheet_ordinal").distinct()
    if verdicts is not None:
        targets = targets.join(verdicts.filter("valid").select(*KEY), KEY, "left_semi")
    return targets


# --- the verdict ------------------------------------------------------------------------------------


def _header_facts(
    authorizations: DataFrame, reports: DataFrame, bindings: DataFrame | None,
    contract: DataFrame,
) -> DataFrame:
    """One row per authorization: stage, identity, and the findings about itself."""
    reported = reports.select(
        *KEY, F.sha2(F.col("report_text"), 256).alias("_id"), F.col("source_id").alias("_source"),
        _precondition().alias("_stop"),
    )
    facts = authorizations.join(contract, KEY).join(reported, KEY, "left")
    root_rules: list[Rule] = []
    if bindings is not None:
        bound = _judged_bindings(bindings).withColumn("_bound", F.lit(True))
        facts = facts.join(bound, KEY, "left")
        root_rules = _output_rules()
    stage = F.expr(
        "CASE WHEN contract_errors > 0 THEN 'invalid' "
        "WHEN _id IS NULL OR _stop IS NOT NULL THEN 'stopped' ELSE 'open' END"
    )
    facts = facts.withColumn("stage", stage).withColumn(
        "identity", F.expr("coalesce(inspection_report_id = _id, false)")
    )
    own = _found(
        [
            _rule("stage = 'invalid'", "AUTHORIZATION_INVALID", "$.authorization", "contract_errors"),
            _rule("stage <> 'invalid' AND NOT identity", "INSPECTION_REPORT_ID_MISMATCH",
                  "$.authorization.inspectionReportId"),
            _rule("stage = 'stopped' AND _stop = 'REPORT_VERSION_UNSUPPORTED'",
                  "REPORT_VERSION_UNSUPPORTED", "$.report.reportVersion"),
            _rule("stage = 'stopped' AND coalesce(_stop, '') <> 'REPORT_VERSION_UNSUPPORTED'",
                  "REPORT_NOT_VERIFIED", "$.report"),
            _rule("stage = 'open' AND NOT (source_id <=> _source)", "SOURCE_ID_MISMATCH",
                  "$.authorization.sourceId"),
            _rule("stage = 'open' AND NOT has_target", "NO_NORMALIZE_TARGET_SHEET", SHEETS_PATH),
            _rule("stage = 'open' AND NOT human_review_completed", "HUMAN_REVIEW_INCOMPLETE",
                  "$.authorization.humanReviewCompleted"),
        ]
    )
    root = _found(root_rules) if root_rules else F.array().cast(_RULES)
    bound = "_bound AND size(_root) = 0" if root_rules else "false"
    return facts.withColumn("_own", own).withColumn("_root", root).select(
        *KEY, "stage",
        F.expr("stage <> 'invalid' AND identity AS report_identity_matched"),
        F.expr("stage <> 'invalid' AND human_review_completed AS human_review_completed"),
        F.expr(f"coalesce(stage = 'open' AND {bound}, false) AS output_root_authorized"),
        F.expr("CASE WHEN stage = 'open' THEN concat(_own, _root) ELSE _own END AS own_findings"),
    )


_RULES = "array<struct<code:string,path:string,occurrences:bigint>>"


def _sheet_rules() -> list[Rule]:
    return [
        *_coverage_rules(), *_header_rules(), *_non_tabular_rules(), *_model_reference_rules(),
        *_resolution_rules(),
        _rule("report_rows > 1", "REPORT_SHEET_ORDINAL_DUPLICATE", "$.report.sheets", "report_rows - 1"),
        _rule("bad_rows > 0", "REPORT_SHEET_ORDINAL_INVALID", "$.report.sheets", "bad_rows"),
    ]


def _occurrences(rules: list[Rule]) -> Column:
    """How many findings the rules give, without building one."""
    return F.expr(" + ".join(r.count() for r in rules))


def _counted(findings: DataFrame) -> DataFrame:
    return findings.groupBy(*KEY, "f.code", "f.path").agg(
        F.sum("f.occurrences").alias("occurrences")
    )


def authorization_findings(
    authorizations: DataFrame, auth_sheets: DataFrame, acks: DataFrame, reviews: DataFrame,
    reports: DataFrame, report_sheets: DataFrame, report_findings: DataFrame,
    bindings: DataFrame | None = None,
) -> DataFrame:
    """All findings of all checks; `occurrences` counts indistinguishable repeats.

    Contract errors end an authorization, report preconditions end its later checks.
    """
    contract = authorization_contract(authorizations, auth_sheets, acks, reviews)
    header = _header_facts(authorizations, reports, bindings, contract)
    ledger = sheet_ledger(report_sheets, auth_sheets, report_findings, reviews)
    return _findings_of(header, ledger, finding_ledger(report_findings, acks))


def _findings_of(header: DataFrame, ledger: DataFrame, finding_rows: DataFrame) -> DataFrame:
    own = header.select(*KEY, F.explode("own_findings").alias("f"))
    sheets = ledger.select(*KEY, F.explode(_found(_sheet_rules())).alias("f"))
    judged = finding_rows.withColumn("verdict", _verdict())
    findings = judged.select(*KEY, F.explode(_found(_finding_rules())).alias("f"))
    usable = header.filter("stage = 'open'")
    later = _counted(sheets.unionByName(findings)).join(usable.select(*KEY), KEY, "left_semi")
    return later.unionByName(_counted(own)).select(
        *KEY, F.lit(S.ERROR).alias("severity"), "code", "path", "occurrences"
    )


def authorization_verdict(
    authorizations: DataFrame, auth_sheets: DataFrame, acks: DataFrame, reviews: DataFrame,
    reports: DataFrame, report_sheets: DataFrame, report_findings: DataFrame,
    bindings: DataFrame | None = None,
) -> DataFrame:
    """One row per authorization: valid, the flags, blocking, reviewed and finding counts.

    Both ledgers are reduced to one row per authorization before they meet its header, so the
    joins are between tables of that size.
    """
    contract = authorization_contract(authorizations, auth_sheets, acks, reviews)
    header = _header_facts(authorizations, reports, bindings, contract)
    ledger = sheet_ledger(report_sheets, auth_sheets, report_findings, reviews)
    return _verdicts_of(header, ledger, finding_ledger(report_findings, acks))


@dataclass(frozen=True)
class Judgement:
    verdicts: DataFrame
    findings: DataFrame


def authorization_judgement(
    authorizations: DataFrame, auth_sheets: DataFrame, acks: DataFrame, reviews: DataFrame,
    reports: DataFrame, report_sheets: DataFrame, report_findings: DataFrame,
    bindings: DataFrame | None = None,
) -> Judgement:
    """Verdicts and findings together: the contract, the header and both ledgers are built once, as tables."""
    contract = authorization_contract(authorizations, auth_sheets, acks, reviews)
    shared = (
        staged(_header_facts(authorizations, reports, bindings, contract), "header"),
        staged(sheet_ledger(report_sheets, auth_sheets, report_findings, reviews), "sheet-ledger"),
        staged(finding_ledger(report_findings, acks), "finding-ledger"),
    )
    return Judgement(_verdicts_of(*shared), _findings_of(*shared))


def _verdicts_of(header: DataFrame, ledger: DataFrame, finding_rows: DataFrame) -> DataFrame:
    by_sheet = ledger.groupBy(*KEY).agg(
        F.sum(_occurrences(_sheet_rules())).alias("s_found"), _coverage_flag().alias("s_covered")
    )
    judged = finding_rows.withColumn("verdict", _verdict())
    by_finding = judged.groupBy(*KEY).agg(
        F.expr("count_if(verdict <> 'REVIEWED') AS f_blocking"),
        F.expr("count_if(verdict = 'REVIEWED') AS f_reviewed"),
        F.sum(_occurrences(_finding_rules())).alias("f_found"),
        F.expr("bool_and(f IS NOT NULL AND k IS NOT NULL) AS f_covered"),
    )
    joined = header.join(by_sheet, KEY, "left").join(by_finding, KEY, "left")
    total = (
        "aggregate(own_findings, 0L, (n, f) -> n + f.occurrences) "
        "+ IF(stage = 'open', coalesce(s_found, 0) + coalesce(f_found, 0), 0)"
    )
    return joined.withColumn("_total", F.expr(total)).select(
        *KEY,
        F.expr("_total = 0 AS valid"),
        "report_identity_matched",
        F.expr("stage = 'open' AND coalesce(s_covered, false) AS sheet_coverage_complete"),
        F.expr("stage = 'open' AND coalesce(f_covered, true) AS finding_coverage_complete"),
        "output_root_authorized",
        "human_review_completed",
        F.expr("CAST(IF(stage = 'open', coalesce(f_blocking, 0), 0) AS BIGINT) AS blocking_finding_count"),
        F.expr("CAST(IF(stage = 'open', coalesce(f_reviewed, 0), 0) AS BIGINT) AS reviewed_finding_count"),
        F.expr("_total AS finding_count"),
    )


def authorization_gate(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """Reasons why normalization may not start: failed or absent flags, and codes with counts.

    `detail` names the flag or the validator's code. No row for an authorization means go.
    """
    reasons = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(flag).isNull(),
                    F.struct(F.lit("AUTHORIZATION_FLAG_MISSING").alias("code"), F.lit(flag).alias("detail")),
                ).when(
                    ~F.col(flag),
                    F.struct(F.lit("AUTHORIZATION_VALIDATION_FAILED").alias("code"), F.lit(flag).alias("detail")),
                )
                for flag in S.AUTHORIZATION_FLAGS
            ]
        )
    )
    flags = verdicts.select(*KEY, F.explode(reasons).alias("f")).select(
        *KEY, "f.code", "f.detail", F.lit(1).cast("bigint").alias("occurrences")
    )
    codes = findings.groupBy(*KEY, F.col("code").alias("detail")).agg(
        F.sum("occurrences").alias("occurrences")
    ).select(*KEY, F.lit("AUTHORIZATION_VALIDATION_FAILED").alias("code"), "detail", "occurrences")
    return flags.unionByName(codes).withColumn("severity", F.lit(S.ERROR)).withColumn(
        "path", F.lit("$.authorization")
    )


def authorized_mapping(
    requests: DataFrame, auth_sheets: DataFrame, report_sheets: DataFrame,
    authorized: DataFrame,
) -> DataFrame:
    """First reason a mapping spec may not run, per spec; `code` is null when it may.

    `authorized` holds the (authorization, ordinal) pairs cleared for normalization. Report
    sheets are found by their ordinal, never by position.
    """
    wanted = requests.withColumnRenamed("source_sheet_ordinal", "sheet_ordinal")
    ledger = sheet_ledger(report_sheets, auth_sheets)
    cleared = authorized.select(*SHEET_KEY).distinct().withColumn("_cleared", F.lit(True))
    joined = wanted.join(ledger, SHEET_KEY, "left").join(cleared, SHEET_KEY, "left")
    table = F.coalesce(F.col("a.classification") == "data_table", F.lit(False))
    code = (
        F.when(F.col("_cleared").isNull() | ~table, "MAPPING_SHEET_NOT_AUTHORIZED")
        .when(~F.col("a.header_row").eqNullSafe(F.col("header_row")), "AUTHORIZATION_HEADER_MISMATCH")
        .when(F.col("r").isNull(), "INSPECTION_SHEET_OUT_OF_RANGE")
        .when(~F.col("r.inferred_header_row").eqNullSafe(F.col("header_row")), "INSPECTION_HEADER_MISMATCH")
    )
    return joined.select("spec_id", *SHEET_KEY, code.alias("code"))


def key_set_difference(report_sheets: DataFrame, auth_sheets: DataFrame) -> DataFrame:
    """Sheet ordinals on one side only, in both directions: one grouping that holds every key once."""
    report = report_sheets.filter("sheet_ordinal >= 0").select(*SHEET_KEY, F.lit(1).alias("side"))
    authorized = auth_sheets.select(*SHEET_KEY, F.lit(2).alias("side"))
    sides = spread(report.unionByName(authorized), *SHEET_KEY).groupBy(*SHEET_KEY).agg(F.bit_or("side").alias("side"))
    missing = F.when(F.col("side") == 1, "authorization").when(F.col("side") == 2, "report")
    return sides.select(*SHEET_KEY, missing.alias("missing_from")).filter("missing_from IS NOT NULL")
