"""Queries over reports and authorizations."""

from __future__ import annotations

from steward.operators import authorize as az, keys as ky
from steward.plans.bindings import bind
from steward.plans.registry import query
from steward.staging import staged

_BLOCKING = ("('WORKBOOK_SCAN_LIMIT_REACHED', 'WORKBOOK_HEADER_NOT_DETECTED', "
             "'WORKBOOK_XML_PART_SCAN_SKIPPED')")
_REVIEWABLE = ("('WORKBOOK_DECLARED_DIMENSION_EXCESSIVE', 'WORKBOOK_PROTECTION_ENABLED', "
               "'WORKBOOK_CUSTOM_XML_PRESENT', 'WORKBOOK_DIGITAL_SIGNATURE_PRESENT', "
               "'WORKBOOK_EMPTY_SHEET', 'WORKBOOK_DRAWING_ONLY_SHEET')")

_STEPS = {
    "keyed_findings": r"""
select authorization_id, finding_index, severity, code,
       cast(nullif(regexp_extract(path, '\$\.sheets\.(\d+)', 1), '') as int) as sheet_ordinal
from report_findings""",
    "ranked_findings": """
select *, row_number() over (partition by authorization_id, code, sheet_ordinal
                             order by finding_index) as rn
from keyed_findings""",
    "report_keys": "select * from ranked_findings where rn = 1",
    "ranked_sheets": """
select *, row_number() over (partition by authorization_id, sheet_ordinal
                             order by sheet_index) as rn
from report_sheets where sheet_ordinal >= 0""",
    "known_sheets": "select * from ranked_sheets where rn = 1",
    "ack_keys": """
select authorization_id, code, sheet_ordinal,
       arg_max(disposition, case disposition when 'accepted_for_reviewed_scope' then 0
                                             when 'resolved' then 1 else 2 end) as disposition
from acks group by authorization_id, code, sheet_ordinal""",
    "drawn": """
select distinct authorization_id, sheet_ordinal from report_keys
where code = 'WORKBOOK_DRAWING_ONLY_SHEET' and sheet_ordinal is not null""",
    "emptied": """
select distinct authorization_id, sheet_ordinal from report_keys
where code = 'WORKBOOK_EMPTY_SHEET' and sheet_ordinal is not null""",
    "one_sheet": """
select * from (select *, row_number() over (
    partition by authorization_id, sheet_ordinal
    order by classification desc, normalize desc, header_row desc nulls last, header_confidence desc) as rn
  from auth_sheets) s where rn = 1""",
    "sheet_pairs": """
select coalesce(r.authorization_id, a.authorization_id) as authorization_id,
       coalesce(r.sheet_ordinal, a.sheet_ordinal) as sheet_ordinal,
       r.authorization_id is not null as in_report, a.authorization_id is not null as in_auth,
       inferred_header_row, r.header_confidence as report_confidence,
       classification, normalize, header_row, a.header_confidence
from known_sheets r full outer join one_sheet a
  on r.authorization_id = a.authorization_id and r.sheet_ordinal = a.sheet_ordinal""",
    "coverage_findings": """
select authorization_id, sheet_ordinal, 'ERROR' as severity,
       case when in_auth then 'SHEET_AUTHORIZATION_EXTRA' else 'SHEET_AUTHORIZATION_MISSING' end as code,
       '$.authorization.sheets' as path
from sheet_pairs where not (in_report and in_auth)""",
    "header_findings": """
select authorization_id, sheet_ordinal, 'ERROR' as severity, 'HEADER_ROW_MISMATCH' as code,
       '$.authorization.sheets.' || sheet_ordinal || '.headerRow' as path
from sheet_pairs where in_report and classification = 'data_table'
  and inferred_header_row is distinct from header_row
union all
select authorization_id, sheet_ordinal, 'ERROR', 'HEADER_CONFIDENCE_MISMATCH',
       '$.authorization.sheets.' || sheet_ordinal || '.headerConfidence'
from sheet_pairs where in_report and classification = 'data_table'
  and report_confidence is distinct from header_confidence""",
    "tabular_findings": """
select a.authorization_id, a.sheet_ordinal, 'ERROR' as severity,
       'EMPTY_SHEET_CLASSIFICATION_INVALID' as code, '$.authorization.sheets.' || a.sheet_ordinal as path
from one_sheet a join emptied e on a.authorization_id = e.authorization_id and a.sheet_ordinal = e.sheet_ordinal
where classification not in ('metadata_or_readme', 'excluded_non_data')
union all
select a.authorization_id, a.sheet_ordinal, 'ERROR', 'DRAWING_ONLY_SHEET_CLASSIFICATION_INVALID',
       '$.authorization.sheets.' || a.sheet_ordinal
from one_sheet a join drawn d on a.authorization_id = d.authorization_id and a.sheet_ordinal = d.sheet_ordinal
where classification not in ('metadata_or_readme', 'excluded_non_data', 'model_reference')""",
    "model_sheets": """
select a.authorization_id, a.sheet_ordinal, d.authorization_id is not null as is_drawn,
       v.authorization_id is not null as reviewed, v.* exclude (authorization_id, sheet_ordinal)
from one_sheet a
left join drawn d on a.authorization_id = d.authorization_id and a.sheet_ordinal = d.sheet_ordinal
left join reviews v on a.authorization_id = v.authorization_id and a.sheet_ordinal = v.sheet_ordinal
where classification = 'model_reference'""",
    "model_codes": """
select authorization_id, sheet_ordinal, unnest(case
    when not is_drawn then ['MODEL_REFERENCE_CLASSIFICATION_INVALID']
    when not reviewed then ['MODEL_REFERENCE_REVIEW_REQUIRED']
    when drawing_review_category <> 'imo_compendium_model_reference'
      then ['MODEL_REFERENCE_CLASSIFICATION_INVALID']
    else list_filter([
      case when not completed then 'MODEL_REFERENCE_REVIEW_REQUIRED' end,
      case when not reference_model_alignment_approved then 'REFERENCE_MODEL_ALIGNMENT_NOT_APPROVED' end,
      case when not model_reference_scope_approved then 'MODEL_REFERENCE_SCOPE_NOT_APPROVED' end,
      case when not model_reference_reviewer_recorded then 'MODEL_REFERENCE_REVIEWER_NOT_RECORDED' end,
      case when evidence_reference_id is null or not external_verification_asserted
                or external_verification_technically_confirmed
           then 'MODEL_REFERENCE_REVIEW_EVIDENCE_NOT_VERIFIED' end], lambda x : x is not null) end) as code
from model_sheets""",
    "model_findings": """
select v.authorization_id, v.sheet_ordinal, 'ERROR' as severity,
       'MODEL_REFERENCE_CLASSIFICATION_INVALID' as code, '$.authorization.modelReferenceReviews' as path
from reviews v left join drawn d
  on v.authorization_id = d.authorization_id and v.sheet_ordinal = d.sheet_ordinal
where d.authorization_id is null
union all
select authorization_id, sheet_ordinal, 'ERROR', code, '$.authorization.sheets.' || sheet_ordinal
from model_codes""",
    "resolution_findings": """
select a.authorization_id, a.sheet_ordinal, 'ERROR' as severity,
       'MODEL_REFERENCE_AUTHORIZATION_CLASSIFICATION_UNRESOLVED' as code,
       '$.authorization.sheets.' || a.sheet_ordinal as path
from one_sheet a join drawn d on a.authorization_id = d.authorization_id and a.sheet_ordinal = d.sheet_ordinal
left join reviews v on a.authorization_id = v.authorization_id and a.sheet_ordinal = v.sheet_ordinal
where classification in ('metadata_or_readme', 'excluded_non_data')
  and not coalesce(completed and classification =
        case drawing_review_category when 'documentation' then 'metadata_or_readme'
             when 'out_of_scope_visual' then 'excluded_non_data' end, false)""",
    "judged_findings": f"""
select f.authorization_id, f.code, f.sheet_ordinal, f.severity, k.disposition,
       case when f.severity = 'ERROR' then 'FATAL_FINDING_PRESENT'
            when f.code in {_BLOCKING} then 'CURRENT_REPORT_BLOCKING_FINDING'
            when k.authorization_id is null then 'FINDING_AUTHORIZATION_MISSING'
            when f.code in {_REVIEWABLE} and k.disposition = 'accepted_for_reviewed_scope' then 'REVIEWED'
            when f.code in {_REVIEWABLE} then 'BLOCKING_FINDING_UNRESOLVED'
            else 'UNKNOWN_FINDING_BLOCKING' end as verdict,
       k.authorization_id is not null as acknowledged
from report_keys f left join ack_keys k
  on f.authorization_id = k.authorization_id and f.code = k.code
 and f.sheet_ordinal is not distinct from k.sheet_ordinal""",
    "stale": """
select k.authorization_id, k.code, k.sheet_ordinal from ack_keys k left join report_keys f
  on f.authorization_id = k.authorization_id and f.code = k.code
 and f.sheet_ordinal is not distinct from k.sheet_ordinal
where f.authorization_id is null""",
    "output_findings": """
select authorization_id, 'ERROR' as severity, code, path from (
  select b.authorization_id, unnest(case when bad then [{'code': 'OUTPUT_ROOT_BINDING_INVALID', 'path': '$.binding'}]
    else list_filter([
      case when root_id <> approved_output_root_id
           then {'code': 'OUTPUT_ROOT_ID_MISMATCH', 'path': '$.binding.rootId'} end,
      case when not starts_with(regexp_replace(regexp_replace(regexp_replace(output_dir, '/+', '/', 'g'),
                  '/[a-z0-9]+/[.][.]', ''), '/[a-z0-9]+/[.][.]', '') || '/', root_path || '/')
           then {'code': 'OUTPUT_DIR_OUTSIDE_APPROVED_ROOT', 'path': '$.outputDir'} end],
      lambda x : x is not null) end, recursive := true)
  from (select *, version < 1 or root_path not like '/%' as bad from output_bindings) b
  join authorizations a on a.authorization_id = b.authorization_id) x""",
    "sheet_field_errors": """
select *, (sheet_ordinal < 0)::int + (classification = 'diagram')::int
        + coalesce((not regexp_full_match(exclusion_reason_code, '[A-Z][A-Z0-9_]{2,63}'))::int, 0) as n_fields,
  case when classification = 'data_table' then
         case when not normalize then 'data_table_not_normalized'
              when header_row is null then 'data_table_without_header'
              when header_confidence not in ('high', 'medium') then 'data_table_confidence'
              when header_confidence = 'medium' and not medium_confidence_approved then 'data_table_medium_unapproved'
              when exclusion_reason_code is not null then 'data_table_excluded' end
       when normalize then 'normalized_non_table'
       when classification in ('metadata_or_readme', 'excluded_non_data') and exclusion_reason_code is null
         then 'exclusion_without_reason'
       when classification = 'model_reference' then
         case when header_row is not null then 'model_reference_header'
              when header_confidence <> 'none' then 'model_reference_confidence'
              when medium_confidence_approved then 'model_reference_medium_approved'
              when exclusion_reason_code is not null then 'model_reference_excluded' end end as invariant
from auth_sheets""",
    "contract_counts": """
select a.authorization_id,
       (a.version < 1)::int + (not regexp_full_match(inspection_report_id, '[0-9a-f]{64}'))::int
         + (not regexp_full_match(approved_output_root_id, '[A-Z][A-Z0-9_-]{2,63}'))::int
         + coalesce(s.n, 0) + coalesce(k.n, 0) + coalesce(v.n, 0) as field_errors,
       coalesce(s.dup, false) or coalesce(k.dup, false) or coalesce(v.dup, false) as repeated
from authorizations a
left join (select authorization_id, sum(n) as n, bool_or(c > 1) as dup from (
             select authorization_id, sheet_ordinal, count(*) as c,
                    sum(case when n_fields > 0 then n_fields when invariant is not null then 1 else 0 end) as n
             from sheet_field_errors group by all) x group by all) s on a.authorization_id = s.authorization_id
left join (select authorization_id, sum(n) as n, bool_or(c > 1) as dup from (
             select authorization_id, code, sheet_ordinal, count(*) as c,
                    sum((not regexp_full_match(reason_code, '[A-Z][A-Z0-9_]{2,63}'))::int) as n
             from acks group by all) x group by all) k on a.authorization_id = k.authorization_id
left join (select authorization_id, sum(n) as n, bool_or(c > 1) as dup from (
             select authorization_id, sheet_ordinal, count(*) as c,
                    sum(coalesce((not regexp_full_match(evidence_reference_id, '[A-Z][A-Z0-9_-]{2,63}'))::int, 0)) as n
             from reviews group by all) x group by all) v on a.authorization_id = v.authorization_id""",
    "contract_errors": """
select authorization_id, cast(case when field_errors > 0 then field_errors when repeated then 1 else 0 end as bigint)
         as contract_errors from contract_counts""",
    "preconditions": """
select authorization_id, case when report_version <> 1 then 'REPORT_VERSION_UNSUPPORTED'
         when not (provenance_verified and manifest_status = 'verified'
                   and inspection_mode = 'verified-source' and inspection_completed) then 'REPORT_NOT_VERIFIED'
         end as stop_code from reports""",
    "stages": """
select a.*, c.contract_errors, p.stop_code, r.source_id as report_source,
       inspection_report_id = sha256(report_text) as identity,
       case when contract_errors > 0 then 'invalid' when stop_code is not null then 'stopped' else 'open' end as stage
from authorizations a join contract_errors c on a.authorization_id = c.authorization_id
join reports r on a.authorization_id = r.authorization_id
join preconditions p on a.authorization_id = p.authorization_id""",
    "open_findings": """
select authorization_id, code, path from coverage_findings
union all select authorization_id, code, path from header_findings
union all select authorization_id, code, path from tabular_findings
union all select authorization_id, code, path from model_findings
union all select authorization_id, code, path from resolution_findings
union all select authorization_id, code, path from output_findings
union all select authorization_id, 'REPORT_SHEET_ORDINAL_DUPLICATE', '$.report.sheets' from ranked_sheets where rn > 1
union all select authorization_id, 'REPORT_SHEET_ORDINAL_INVALID', '$.report.sheets' from report_sheets where not sheet_ordinal >= 0
union all select authorization_id, 'REPORT_FINDING_DUPLICATE', '$.report.findings' from ranked_findings where rn > 1
union all select authorization_id, verdict,
       case when verdict in ('FATAL_FINDING_PRESENT', 'CURRENT_REPORT_BLOCKING_FINDING')
            then '$.report.findings' else '$.authorization.acknowledgedFindings' end
from judged_findings where verdict <> 'REVIEWED'
union all select authorization_id, 'FINDING_AUTHORIZATION_STALE', '$.authorization.acknowledgedFindings' from stale
union all select authorization_id, 'SOURCE_ID_MISMATCH', '$.authorization.sourceId' from stages where source_id <> report_source
union all select authorization_id, 'HUMAN_REVIEW_INCOMPLETE', '$.authorization.humanReviewCompleted' from stages where not human_review_completed
union all select authorization_id, 'NO_NORMALIZE_TARGET_SHEET', '$.authorization.sheets' from stages s
where not exists (select 1 from auth_sheets t where t.authorization_id = s.authorization_id
                  and classification = 'data_table' and normalize)""",
    "every_finding": """
select authorization_id, 'AUTHORIZATION_INVALID' as code, '$.authorization' as path, contract_errors as n
from stages where stage = 'invalid'
union all
select authorization_id, 'INSPECTION_REPORT_ID_MISMATCH', '$.authorization.inspectionReportId', 1
from stages where stage <> 'invalid' and not identity
union all
select authorization_id, stop_code,
       case when stop_code = 'REPORT_NOT_VERIFIED' then '$.report' else '$.report.reportVersion' end, 1
from stages where stage = 'stopped'
union all
select f.authorization_id, f.code, f.path, count(*) from open_findings f
join stages s on f.authorization_id = s.authorization_id and s.stage = 'open'
group by f.authorization_id, f.code, f.path""",
    "verdicts_by_authorization": """
select s.authorization_id,
       coalesce(e.total, 0) = 0 as valid,
       s.stage <> 'invalid' and s.identity as report_identity_matched,
       s.stage = 'open' and coalesce(c.covered, false) as sheet_coverage_complete,
       s.stage = 'open' and coalesce(j.acked, true) and not coalesce(t.any_stale, false) as finding_coverage_complete,
       s.stage = 'open' and coalesce(o.n, 0) = 0 as output_root_authorized,
       s.stage <> 'invalid' and s.human_review_completed as human_review_completed,
       cast(case when s.stage = 'open' then coalesce(j.blocking, 0) else 0 end as bigint) as blocking_finding_count,
       cast(case when s.stage = 'open' then coalesce(j.reviewed, 0) else 0 end as bigint) as reviewed_finding_count,
       cast(coalesce(e.total, 0) as bigint) as finding_count
from stages s
left join (select authorization_id, sum(n) as total from every_finding group by all) e on s.authorization_id = e.authorization_id
left join (select authorization_id, bool_and(in_report and in_auth) as covered from sheet_pairs group by all) c
  on s.authorization_id = c.authorization_id
left join (select authorization_id, bool_and(acknowledged) as acked,
                  count(*) filter (where verdict <> 'REVIEWED') as blocking,
                  count(*) filter (where verdict = 'REVIEWED') as reviewed
           from judged_findings group by all) j on s.authorization_id = j.authorization_id
left join (select authorization_id, true as any_stale from stale group by all) t on s.authorization_id = t.authorization_id
left join (select authorization_id, count(*) as n from output_findings group by all) o on s.authorization_id = o.authorization_id""",
}


def _load(spark, sf, *names):
    return [bind(spark, sf, n) for n in names]


_ALL = ("authorizations", "auth_sheets", "acks", "reviews", "reports", "report_sheets",
        "report_findings", "output_bindings")


@query(oracle="select authorization_id, sheet_index, problem from (select *, case when n_fields = 0 then invariant end as problem from sheet_field_errors) x where problem is not null", **_STEPS)
def q_check_sheet_authorization(spark, sf):
    return az.check_sheet_authorization(*_load(spark, sf, "auth_sheets")).drop("sheet_ordinal")


@query(
    oracle="""
select authorization_id, 'sheets' as kind, cast(null as varchar) as code, sheet_ordinal, count(*) as occurrences
from auth_sheets group by authorization_id, sheet_ordinal having count(*) > 1
union all
select authorization_id, 'acknowledgedFindings', code, sheet_ordinal, count(*)
from acks group by authorization_id, code, sheet_ordinal having count(*) > 1
union all
select authorization_id, 'modelReferenceReviews', null, sheet_ordinal, count(*)
from reviews group by authorization_id, sheet_ordinal having count(*) > 1
""",
)
def q_duplicate_authorization_keys(spark, sf):
    return ky.duplicate_authorization_keys(*_load(spark, sf, "auth_sheets", "acks", "reviews"))


@query(
    oracle="""
select authorization_id, 'ERROR' as severity, 'REPORT_SHEET_ORDINAL_DUPLICATE' as code,
       '$.report.sheets' as path, sheet_index from ranked_sheets where rn > 1
union all
select authorization_id, 'ERROR', 'REPORT_SHEET_ORDINAL_INVALID', '$.report.sheets', sheet_index
from report_sheets where sheet_ordinal < 0
""",
    **_STEPS,
)
def q_report_sheet_keys(spark, sf):
    return ky.report_sheet_keys(*_load(spark, sf, "report_sheets"))[1]


@query(
    oracle="""
select authorization_id, 'ERROR' as severity, 'REPORT_FINDING_DUPLICATE' as code,
       '$.report.findings' as path, finding_index from ranked_findings where rn > 1
""",
    **_STEPS,
)
def q_report_finding_keys(spark, sf):
    return ky.report_finding_keys(*_load(spark, sf, "report_findings"))[1]


@query(oracle="select * from coverage_findings", **_STEPS)
def q_sheet_coverage(spark, sf):
    return az.sheet_coverage(*_load(spark, sf, "report_sheets", "auth_sheets"))


@query(
    oracle="""
select authorization_id, bool_and(in_report and in_auth) as sheet_coverage_complete
from sheet_pairs group by authorization_id
""",
    **_STEPS,
)
def q_sheet_coverage_flag(spark, sf):
    return az.sheet_coverage_flag(*_load(spark, sf, "report_sheets", "auth_sheets"))


@query(oracle="select * from header_findings", **_STEPS)
def q_header_match(spark, sf):
    return az.header_match(*_load(spark, sf, "report_sheets", "auth_sheets"))


@query(
    oracle="""
select authorization_id, code, sheet_ordinal, severity, disposition,
       case when not acknowledged then 'FINDING_AUTHORIZATION_MISSING' end as missing
from judged_findings
""",
    **_STEPS,
)
def q_finding_acks(spark, sf):
    return az.finding_acks(*_load(spark, sf, "report_findings", "acks"))


@query(
    oracle="select *, 'FINDING_AUTHORIZATION_STALE' as finding_code from stale", **_STEPS
)
def q_stale_acks(spark, sf):
    return az.stale_acks(*_load(spark, sf, "report_findings", "acks"))


@query(oracle="select * from tabular_findings", **_STEPS)
def q_non_tabular_policy(spark, sf):
    return az.non_tabular_policy(*_load(spark, sf, "report_findings", "auth_sheets"))


@query(oracle="select * from model_findings", **_STEPS)
def q_model_reference_review(spark, sf):
    return az.model_reference_review(*_load(spark, sf, "report_findings", "auth_sheets", "reviews"))


@query(oracle="select * from resolution_findings", **_STEPS)
def q_drawing_resolution(spark, sf):
    return az.drawing_resolution(*_load(spark, sf, "report_findings", "auth_sheets", "reviews"))


@query(
    oracle="""
select authorization_id, code, sheet_ordinal, verdict, verdict <> 'REVIEWED' as blocking
from judged_findings
""",
    **_STEPS,
)
def q_classify_findings(spark, sf):
    return az.classify_findings(*_load(spark, sf, "report_findings", "acks"))


@query(
    oracle="""
select a.authorization_id,
       coalesce(j.acked, true) and not coalesce(t.any_stale, false) as finding_coverage_complete
from authorizations a
left join (select authorization_id, bool_and(acknowledged) as acked from judged_findings group by all) j
  on a.authorization_id = j.authorization_id
left join (select authorization_id, true as any_stale from stale group by all) t
  on a.authorization_id = t.authorization_id
""",
    **_STEPS,
)
def q_finding_coverage(spark, sf):
    return az.finding_coverage(*_load(spark, sf, "authorizations", "report_findings", "acks"))


@query(oracle="""
select a.authorization_id, inspection_report_id = sha256(report_text) as report_identity_matched
from authorizations a join reports r on a.authorization_id = r.authorization_id
""")
def q_report_identity(spark, sf):
    return az.report_identity(*_load(spark, sf, "authorizations", "reports"))


@query(
    oracle="select authorization_id, stop_code as code from preconditions where stop_code is not null",
    **_STEPS,
)
def q_report_preconditions(spark, sf):
    return az.report_preconditions(*_load(spark, sf, "reports"))


@query(oracle="select * from output_findings", **_STEPS)
def q_output_root_check(spark, sf):
    return az.output_root_check(*_load(spark, sf, "authorizations", "output_bindings"))


@query(oracle="select * from contract_errors", **_STEPS)
def q_authorization_contract(spark, sf):
    return az.authorization_contract(*_load(spark, sf, *_ALL[:4])).drop("has_target")


def _tables(spark, sf):
    """All inputs; those that several ledgers read are written once instead of derived each time."""
    return [
        staged(table, name) if name in ("acks", "reviews", "report_findings") else table
        for name, table in zip(_ALL, _load(spark, sf, *_ALL), strict=True)
    ]


def _verdicts(spark, sf):
    return az.authorization_verdict(*_tables(spark, sf))


@query(oracle="select * from verdicts_by_authorization", **_STEPS)
def q_authorization_verdict(spark, sf):
    return _verdicts(spark, sf)


@query(
    oracle="""
select authorization_id, 'ERROR' as severity, code, path, cast(sum(n) as bigint) as occurrences
from every_finding group by authorization_id, code, path
""",
    **_STEPS,
)
def q_authorization_findings(spark, sf):
    return az.authorization_findings(*_tables(spark, sf))


@query(
    oracle="""
select authorization_id, 'AUTHORIZATION_VALIDATION_FAILED' as code, detail,
       cast(sum(n) as bigint) as occurrences, 'ERROR' as severity, '$.authorization' as path
from (
  select authorization_id, unnest(list_filter([
      case when not valid then 'valid' end,
      case when not report_identity_matched then 'report_identity_matched' end,
      case when not sheet_coverage_complete then 'sheet_coverage_complete' end,
      case when not finding_coverage_complete then 'finding_coverage_complete' end,
      case when not output_root_authorized then 'output_root_authorized' end,
      case when not human_review_completed then 'human_review_completed' end],
      lambda x : x is not null)) as detail, 1 as n
  from verdicts_by_authorization
  union all select authorization_id, code, n from every_finding) g
group by authorization_id, detail
""",
    **_STEPS,
)
def q_authorization_gate(spark, sf):
    judged = az.authorization_judgement(*_tables(spark, sf))
    return az.authorization_gate(judged.verdicts, judged.findings)


@query(
    oracle="""
select distinct s.authorization_id, s.sheet_ordinal
from auth_sheets s join verdicts_by_authorization v on s.authorization_id = v.authorization_id and v.valid
where classification = 'data_table' and normalize
""",
    **_STEPS,
)
def q_authorized_ordinals(spark, sf):
    return az.authorized_ordinals(bind(spark, sf, "auth_sheets"), _verdicts(spark, sf))


@query(
    oracle="""
select m.spec_id, m.authorization_id, m.source_sheet_ordinal as sheet_ordinal,
       case when t.authorization_id is null or p.classification is distinct from 'data_table'
              then 'MAPPING_SHEET_NOT_AUTHORIZED'
            when p.header_row is distinct from m.header_row then 'AUTHORIZATION_HEADER_MISMATCH'
            when not p.in_report then 'INSPECTION_SHEET_OUT_OF_RANGE'
            when p.inferred_header_row is distinct from m.header_row then 'INSPECTION_HEADER_MISMATCH'
       end as code
from mapping_requests m
left join sheet_pairs p on m.authorization_id = p.authorization_id and m.source_sheet_ordinal = p.sheet_ordinal
left join (select distinct authorization_id, sheet_ordinal from auth_sheets
           where classification = 'data_table' and normalize) t
  on m.authorization_id = t.authorization_id and m.source_sheet_ordinal = t.sheet_ordinal
""",
    **_STEPS,
)
def q_authorized_mapping(spark, sf):
    requests, auth_sheets, report_sheets = _load(
        spark, sf, "mapping_requests", "auth_sheets", "report_sheets"
    )
    return az.authorized_mapping(
        requests, auth_sheets, report_sheets, az.authorized_ordinals(auth_sheets)
    ).select("spec_id", "authorization_id", "sheet_ordinal", "code")


@query(
    oracle="""
select authorization_id, sheet_ordinal,
       case when in_report then 'authorization' else 'report' end as missing_from
from sheet_pairs where not (in_report and in_auth)
""",
    **_STEPS,
)
def q_key_set_difference(spark, sf):
    return az.key_set_difference(*_load(spark, sf, "report_sheets", "auth_sheets"))
