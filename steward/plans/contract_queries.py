"""Queries over manifests, provenance, row contracts and JSON documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from steward.operators import contracts as ct, decisions as dc, keys as ky, provenance as pv
from steward.plans.bindings import bind
from steward.plans.registry import query
from steward import schemas as S

# --- manifests ------------------------------------------------------------------------------------

_ABSOLUTE = r"regexp_matches({0}, '^(/|[A-Za-z]:[\\/]|[\\/]{{2}})')"
_PARENT = r"list_contains(string_split(replace({0}, '\', '/'), '/'), '..')"
_ESCAPES = f"({_ABSOLUTE} or {_PARENT})".format("source_file")

_MANIFEST_STEPS = {
    "entry_problems": f"""
select e.*, d.sha256,
  case when has_forbidden_field then ['MANIFEST_FORBIDDEN_FIELD|']
       else list_filter([
         case when source_id is null or source_id = '' then 'MANIFEST_ENTRY_INVALID|.source_id' end,
         case when profile_version is null or profile_version = ''
              then 'MANIFEST_ENTRY_INVALID|.profile_version' end,
         case when {_ESCAPES} then 'SOURCE_PATH_OUTSIDE_BASE|.source_file' end,
         case when not regexp_full_match(source_hash, '[0-9a-f]{{64}}')
              then 'SOURCE_HASH_FORMAT_INVALID|.source_hash' end], lambda x : x is not null)
       end as contract_problems
from manifest_entries e left join file_digests d on e.source_file = d.path""",
    "checked_entries": """
select *, case when len(contract_problems) > 0 then contract_problems
               when sha256 is null then ['SOURCE_FILE_NOT_FOUND|.source_file']
               when sha256 <> source_hash then ['SOURCE_HASH_MISMATCH|.source_hash']
               else [] end as problems
from entry_problems""",
    "manifest_facts": """
select m.manifest_id, m.version, m.pending_shape, count(*) as n,
       count(*) filter (where len(problems) > 0) as bad,
       count(distinct source_id) as ids, count(distinct source_file) as files
from manifests m join checked_entries e on m.manifest_id = e.manifest_id
group by m.manifest_id, m.version, m.pending_shape""",
    "manifest_states": """
select *, case when bad > 0 then null when version < 1 then '$.version'
               when ids < n or files < n then '$' end as contract_path,
       bad = 0 and version >= 1 and ids = n and files = n as passed
from manifest_facts""",
    "verified_entries": """
select e.* from checked_entries e join manifest_states s
  on e.manifest_id = s.manifest_id and s.passed""",
    "workbook_matches": """
select w.workbook_id, min(entry_index) as entry_index, arg_min(source_id, entry_index) as source_id
from workbook_files w join verified_entries e
  on w.manifest_id = e.manifest_id and w.path = e.source_file
group by w.workbook_id""",
}


def _check(spark, sf) -> pv.ManifestCheck:
    return pv.verify_manifest(
        bind(spark, sf, "manifest_entries"), bind(spark, sf, "file_digests"),
        bind(spark, sf, "manifests"),
    )


@query(
    oracle="""
select manifest_id as subject_id, 'ERROR' as severity, split_part(p, '|', 1) as code,
       '$.sources.' || entry_index || split_part(p, '|', 2) as path
from (select manifest_id, entry_index, unnest(problems) as p from checked_entries) x
union all
select manifest_id, 'ERROR', 'MANIFEST_CONTRACT_INVALID', contract_path
from manifest_states where contract_path is not null
""",
    **_MANIFEST_STEPS,
)
def q_verify_manifest(spark, sf):
    return _check(spark, sf).findings


@query(
    oracle="""
select manifest_id, entry_index, source_id, fal_version, ontology_version, profile_version,
       source_file, source_hash, resource_uri, true as verified, 'approved' as status
from verified_entries
""",
    **_MANIFEST_STEPS,
)
def q_verified_entries(spark, sf):
    return _check(spark, sf).entries


@query(oracle="select * from workbook_matches", **_MANIFEST_STEPS)
def q_first_manifest_match(spark, sf):
    return pv.first_manifest_match(bind(spark, sf, "workbook_files"), _check(spark, sf).entries)


@query(
    oracle="""
select w.workbook_id,
       case when passed and m.source_id is not null then 'verified'
            when not passed and pending_shape then 'pending' else 'invalid' end as manifest_state,
       case when passed then m.source_id end as source_id,
       case when passed and m.source_id is null then 'WORKBOOK_NOT_IN_MANIFEST'
            when not passed and pending_shape then 'MANIFEST_NOT_VERIFIED' end as code
from workbook_files w left join manifest_states s on w.manifest_id = s.manifest_id
left join workbook_matches m on w.workbook_id = m.workbook_id
""",
    **_MANIFEST_STEPS,
)
def q_manifest_state(spark, sf):
    return pv.manifest_state(bind(spark, sf, "workbook_files"), _check(spark, sf))


@query(
    oracle="""
select workbook_id as subject_id, 'ERROR' as severity, 'SOURCE_ID_MISMATCH' as code
from workbook_matches
where source_id is distinct from
      (case when entry_index % 6 = 0 then 'SRC-OTHER' when entry_index % 10 = 5 then null
            else 'SRC-' || entry_index end)
""",
    **_MANIFEST_STEPS,
)
def q_source_id_match(spark, sf):
    workbooks = bind(spark, sf, "workbook_files")
    matched = pv.first_manifest_match(workbooks, _check(spark, sf).entries)
    number = F.expr("CAST(substring(workbook_id, 4) AS BIGINT)")
    declared = workbooks.select(
        "workbook_id",
        F.when(number % 6 == 0, "SRC-OTHER")
        .when(number % 10 != 5, F.concat(F.lit("SRC-"), number.cast("string")))
        .alias("source_id"),
    )
    return pv.source_id_match(matched, declared)


@query(oracle="""
select manifest_id, field, value, count(*) as occurrences
from (select manifest_id, 'source_id' as field, source_id as value from manifest_entries
      union all
      select manifest_id, 'source_file', source_file from manifest_entries) v
group by manifest_id, field, value having count(*) > 1
""")
def q_duplicate_sources(spark, sf):
    return ky.duplicate_sources(bind(spark, sf, "manifest_entries"))


_PROVENANCE_STEPS = {
    "judged_provenance": f"""
select *, case when status = 'approved' and not verified then 'approved_requires_verified'
               when {_ABSOLUTE.format('source_file')} then 'absolute_path'
               when {_PARENT.format('source_file')} then 'parent_segment' end as problem,
  list_filter([
    case when source_id = '' then '$.source_id' end,
    case when profile_version is null then '$.profile_version' end,
    case when not regexp_full_match(source_hash, '[0-9a-f]{{64}}') then '$.source_hash' end,
    case when status = 'done' then '$.status' end], lambda x : x is not null) as field_errors
from provenance_entries""",
    "usable_provenance": """
select *, case when len(field_errors) > 0 then list_transform(field_errors, lambda x : 'SOURCE_ENTRY_INVALID|' || x)
               when problem is not null then ['SOURCE_ENTRY_INVALID|$']
               when not verified then ['SOURCE_NOT_VERIFIED|$.verified']
               when status <> 'approved' then ['SOURCE_NOT_APPROVED|$.status'] else [] end as problems
from judged_provenance""",
}


@query(
    oracle="select entry_id, problem from judged_provenance where problem is not null",
    **_PROVENANCE_STEPS,
)
def q_check_provenance(spark, sf):
    return pv.check_provenance(bind(spark, sf, "provenance_entries"))


@query(
    oracle="""
select 'evidence:' || source_id as evidence_id, fal_version, ontology_version, profile_version,
       resource_uri, source_file, source_hash
from usable_provenance where len(problems) = 0
""",
    **_PROVENANCE_STEPS,
)
def q_evidence_build(spark, sf):
    return pv.evidence_build(bind(spark, sf, "provenance_entries"))[0]


@query(
    oracle="""
select entry_id as subject_id, 'ERROR' as severity, split_part(p, '|', 1) as code,
       split_part(p, '|', 2) as path
from (select entry_id, unnest(problems) as p from usable_provenance) x
""",
    **_PROVENANCE_STEPS,
)
def q_evidence_build_findings(spark, sf):
    return pv.evidence_build(bind(spark, sf, "provenance_entries"))[1]


@query(oracle="""
select subject_id, field, value, regexp_full_match(value, pattern) as well_formed from (
  select 'E-' || entry_index as subject_id, 'source_hash' as field, source_hash as value,
         '[0-9a-f]{64}' as pattern from manifest_entries
  union all select authorization_id, 'inspection_report_id', inspection_report_id, '[0-9a-f]{64}'
  from authorizations
  union all select authorization_id, 'approved_output_root_id', approved_output_root_id,
         '[A-Z][A-Z0-9_-]{2,63}' from authorizations
  union all select authorization_id, 'reason_code', reason_code, '[A-Z][A-Z0-9_]{2,63}' from acks) v
""")
def q_check_code_patterns(spark, sf):
    authorization = F.col("authorization_id")
    parts = [
        ct.check_code_patterns(bind(spark, sf, "manifest_entries"), F.expr("'E-' || entry_index"), {"source_hash": S.SHA256_PATTERN}),
        ct.check_code_patterns(bind(spark, sf, "authorizations"), authorization, {
            "inspection_report_id": S.SHA256_PATTERN, "approved_output_root_id": S.ROOT_ID_PATTERN}),
        ct.check_code_patterns(bind(spark, sf, "acks"), authorization, {"reason_code": S.REASON_CODE_PATTERN}),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- ontology rows --------------------------------------------------------------------------------

_OCC_STEPS = {
    "filled_occurrences": """
select * exclude (status), coalesce(status, 'draft') as status from occurrences""",
    "judged_occurrences": """
select *, list_filter([
    case when occurrence_id = '' then '$.occurrence_id' end,
    case when dataset_id is null then '$.dataset_id' end,
    case when sequence < 1 then '$.sequence' end,
    case when status = 'rejected' then '$.status' end], lambda x : x is not null) as field_errors
from filled_occurrences""",
    "occurrence_errors": """
select *, case when len(field_errors) > 0 then field_errors
               when technical_position is null and status = 'approved' then ['$'] else [] end as errors
from judged_occurrences""",
}


@query(
    oracle="""
select row_key as subject_id, 'ERROR' as severity, 'PAYLOAD_VALIDATION_ERROR' as code,
       unnest(errors) as path from occurrence_errors
""",
    **_OCC_STEPS,
)
def q_validate_contract(spark, sf):
    rows = bind(spark, sf, "occurrences")
    return ct.validate_contract(rows, "ElementOccurrence", "row_key")[1]


@query(
    oracle="""
select occurrence_id, dataset_id, element_imo_id, technical_position, sequence, usage, status, row_key
from occurrence_errors where len(errors) = 0
""",
    **_OCC_STEPS,
)
def q_validated_rows(spark, sf):
    valid = ct.validate_contract(bind(spark, sf, "occurrences"), "ElementOccurrence", "row_key")[0]
    return valid.drop("parent_component_id", "cardinality")


@query(oracle="""
select row_key, 'position_required' as problem from occurrences
where technical_position is null and status = 'approved'
""")
def q_check_occurrence(spark, sf):
    rows = bind(spark, sf, "occurrences")
    return rows.select("row_key", ct.occurrence_invariant().alias("problem")).filter(
        "problem is not null"
    )


# --- JSON -------------------------------------------------------------------------------------------


@query(oracle="""
select doc_id, 'ERROR' as severity, 'PAYLOAD_VALIDATION_ERROR' as code, '$.' || key as path
from (select doc_id, unnest(json_keys(doc)) as key from json_docs
      where json_valid(doc) and json_type(doc) = 'OBJECT') k
where key not in ('k', 'status')
""")
def q_forbid_extra_keys(spark, sf):
    return ct.forbid_extra_keys(bind(spark, sf, "json_docs"), ["k", "status"])


@query(
    oracle="""
select doc_id, 'ERROR' as severity, split_part(p, '|', 1) as code,
       nullif(split_part(p, '|', 2), '') as path
from (select doc_id, unnest(problems) as p from contract_docs) x
union all
select -1 - doc_id, 'ERROR', case when doc_id % 2 = 0 then 'SCH_003' else 'SCH_002' end, null from schema_docs where doc_id % 97 = 0
""",
    parsed_docs="""
select doc_id, schema_name, doc, case when json_valid(doc) and json_type(doc) = 'OBJECT'
                                 then cast(doc as json) end as j
from schema_docs""",
    contract_docs="""
select doc_id, case
  when j is null then ['SCH_004|']
  when coalesce(json_type(j, '$."$defs"'), '') <> 'OBJECT' then ['SCH_005|$.$defs']
  when schema_name = 'validation' and contains(doc, '}, "properties": {}}') -- of repeated keys the last counts
    then ['SCH_007|$.$defs.SkillResult.properties.humanReviewRequired']
  when schema_name = 'validation' then
    case when coalesce(json_type(j, '$."$defs".SkillResult'), '') <> 'OBJECT'
         then ['SCH_006|$.$defs.SkillResult']
         else list_filter([
           case when json_type(j, '$."$defs".SkillResult.properties.humanReviewRequired') is null
                then 'SCH_007|$.$defs.SkillResult.properties.humanReviewRequired' end,
           case when json_type(j, '$."$defs".SkillResult.properties.human_review_required') is not null
                then 'SCH_008|$.$defs.SkillResult.properties.human_review_required' end], lambda x : x is not null) end
  else list_filter([
    case when coalesce(json_type(j, '$."$defs".DataElement'), '') <> 'OBJECT'
         then 'SCH_006|$.$defs.DataElement' end,
    case when coalesce(json_type(j, '$."$defs".ElementOccurrence'), '') <> 'OBJECT'
         then 'SCH_006|$.$defs.ElementOccurrence'
         when json_type(j, '$."$defs".ElementOccurrence.properties.element_imo_id') is null
         then 'SCH_007|$.$defs.ElementOccurrence.properties.element_imo_id' end,
    case when json_type(j, '$."$defs".ElementOccurrence.properties.elementImoId') is not null
         then 'SCH_008|$.$defs.ElementOccurrence.properties.elementImoId' end], lambda x : x is not null)
  end as problems
from parsed_docs""",
)
def q_json_contract_check(spark, sf):
    docs = bind(spark, sf, "schema_docs")
    absent = docs.filter("doc_id % 97 = 0").selectExpr(
        "-1 - doc_id AS doc_id", "IF(doc_id % 2 = 0, 'ontology', 'unknown') AS schema_name")
    return ct.json_contract_check(docs, docs.select("doc_id", "schema_name").unionByName(absent))


@query(
    oracle="""
select spec_id, 'MAPPING_SPEC_INVALID' as code,
       case when first_data_row <= header_row then 'data_before_header'
            when ordinals < n then 'duplicate_column_ordinal' else 'duplicate_target_field' end as problem
from spec_stats where first_data_row <= header_row or ordinals < n or fields < n
""",
    spec_stats="""
select spec_id, max(header_row) as header_row, max(first_data_row) as first_data_row,
       count(*) as n, count(distinct source_column_ordinal) as ordinals,
       count(distinct target_field) as fields
from mapping_columns group by spec_id""",
)
def q_check_mapping_spec(spark, sf):
    return ct.check_mapping_spec(bind(spark, sf, "mapping_columns"))


# --- results and decisions -------------------------------------------------------------------------

_RESULT_STEPS = {
    "list_counts": """
select result_id, count(*) filter (where list_name = 'errors') as n_errors,
       count(*) filter (where list_name = 'warnings') as n_warnings,
       count(*) filter (where list_name = 'errors' and severity <> 'ERROR') as bad_errors,
       count(*) filter (where list_name = 'warnings' and severity <> 'WARNING') as bad_warnings
from result_findings group by result_id""",
}


@query(
    oracle="""
select result_id, case when bad_errors > 0 then 'errors_not_error' else 'warnings_not_warning' end as problem
from list_counts where bad_errors > 0 or bad_warnings > 0
""",
    **_RESULT_STEPS,
)
def q_check_result_severity(spark, sf):
    return dc.check_result_severity(bind(spark, sf, "result_findings"))


@query(
    oracle="""
select * from (
  select r.result_id, case
    when status = 'PASS' and coalesce(n_errors, 0) > 0 then 'pass_with_errors'
    when status = 'PASS' and coalesce(n_warnings, 0) > 0 then 'pass_with_warnings'
    when status = 'PASS' and human_review_required then 'pass_with_review'
    when status = 'WARNING' and coalesce(n_errors, 0) > 0 then 'warning_with_errors'
    when status = 'WARNING' and coalesce(n_warnings, 0) = 0 then 'warning_without_warnings'
    when status = 'WARNING' and not human_review_required then 'warning_without_review'
    when status = 'FAIL' and coalesce(n_errors, 0) = 0 then 'fail_without_errors'
    when status = 'FAIL' and not human_review_required then 'fail_without_review' end as problem
  from results r left join list_counts c on r.result_id = c.result_id) x
where problem is not null
""",
    **_RESULT_STEPS,
)
def q_check_result_status(spark, sf):
    return dc.check_result_status(bind(spark, sf, "results"), bind(spark, sf, "result_findings"))


@query(oracle="""
select result_id, 'duplicate_evidence_id' as problem, evidence_id
from result_evidence group by result_id, evidence_id having count(*) > 1
union all
select distinct r.result_id, 'dangling_reference', r.ref from result_refs r
where not exists (select 1 from result_evidence e
                  where e.result_id = r.result_id and e.evidence_id = r.ref)
""")
def q_check_evidence_refs(spark, sf):
    return dc.check_evidence_refs(
        bind(spark, sf, "result_evidence"), bind(spark, sf, "result_refs")
    )


_DECISION_STEPS = {
    "good_results": """
select r.* from evidence_results r
where status = 'PASS' and not has_errors
  and exists (select 1 from evidence_items i
              where i.decision_id = r.decision_id and i.result_index = r.result_index)""",
    "usable_items": """
select i.* from evidence_items i join good_results g
  on i.decision_id = g.decision_id and i.result_index = g.result_index""",
    "ranked_items": """
select *, row_number() over (partition by decision_id, evidence_id
                             order by result_index, item_index) as rn,
       first_value(source_hash) over (partition by decision_id, evidence_id
                             order by result_index, item_index) as first_hash,
       first_value(resource_uri) over (partition by decision_id, evidence_id
                             order by result_index, item_index) as first_uri
from usable_items""",
    "unsuccessful": """
select decision_id, 'ERROR' as severity, 'EVIDENCE_RESULT_NOT_SUCCESSFUL' as code,
       '$.evidenceResults.' || result_index as path
from evidence_results r
where not exists (select 1 from good_results g
                  where g.decision_id = r.decision_id and g.result_index = r.result_index)""",
    "conflicts": """
select decision_id, 'ERROR' as severity, 'EVIDENCE_ID_CONFLICT' as code,
       '$.evidenceResults.' || result_index as path, evidence_id, result_index, item_index
from ranked_items
where source_hash <> first_hash or resource_uri is distinct from first_uri""",
    "decision_counts": """
select d.*, (select count(*) from decision_findings f where f.decision_id = d.decision_id) as n_findings,
       (select count(*) from decision_findings f
        where f.decision_id = d.decision_id and severity = 'ERROR') as n_errors,
       (select count(*) from source_results s
        where s.decision_id = d.decision_id and s.status = 'FAIL') as n_failed
from decisions d""",
    "decision_problems": """
select *, list_filter([case when decision_type = 'UNKNOWN' then '$.decision_type' end,
                       case when subject_id = '' then '$.subject_id' end], lambda x : x is not null) as field_errors,
  case when status = 'APPROVED' and human_review_required then 'approved_with_review'
       when status = 'APPROVED' and n_errors > 0 then 'approved_with_errors'
       when status = 'APPROVED' and n_failed > 0 then 'approved_with_failed_source'
       when status = 'REVIEW_REQUIRED' and not human_review_required then 'review_without_review'
       when status = 'REVIEW_REQUIRED' and n_findings = 0 then 'review_without_findings'
       when status = 'REJECTED' and not human_review_required then 'rejected_without_review'
       when status = 'REJECTED' and n_errors = 0 then 'rejected_without_errors' end as problem
from decision_counts""",
    "decision_outcomes": """
select d.*, (select count(*) from unsuccessful u where u.decision_id = d.decision_id)
          + (select count(*) from conflicts c where c.decision_id = d.decision_id) as n_bad,
       (select count(*) from ranked_items i where i.decision_id = d.decision_id and rn = 1) as evidence_count,
       (select count(*) from decision_refs r where r.decision_id = d.decision_id
        and not exists (select 1 from ranked_items i
                        where i.decision_id = r.decision_id and i.evidence_id = r.ref)) as n_dangling
from decision_problems d""",
}


@query(oracle="select decision_id, severity, code, path from unsuccessful", **_DECISION_STEPS)
def q_successful_evidence_results(spark, sf):
    return dc.successful_evidence_results(
        bind(spark, sf, "evidence_results"), bind(spark, sf, "evidence_items")
    )[1]


@query(
    oracle="""
select decision_id, result_index, item_index, evidence_id, fal_version, ontology_version,
       profile_version, source_hash, resource_uri
from (select *, row_number() over (partition by decision_id, evidence_id
                                   order by result_index, item_index) as rn from evidence_items) i
where rn = 1
""",
)
def q_first_evidence(spark, sf):
    return dc.first_evidence(bind(spark, sf, "evidence_items"))


@query(oracle="select * from conflicts", **_DECISION_STEPS)
def q_evidence_conflicts(spark, sf):
    items, results = bind(spark, sf, "evidence_items"), bind(spark, sf, "evidence_results")
    return dc.evidence_conflicts(dc.usable_items(results, items))


@query(
    oracle="""
select decision_id, problem from decision_problems
where problem is not null and len(field_errors) = 0
""",
    **_DECISION_STEPS,
)
def q_check_decision(spark, sf):
    return dc.check_decision(
        bind(spark, sf, "decisions"), bind(spark, sf, "decision_findings"),
        bind(spark, sf, "source_results"),
    )


def _assemble(spark, sf):
    names = ("decisions", "decision_findings", "decision_refs", "source_results",
             "evidence_results", "evidence_items")
    return dc.assemble_decisions(*[bind(spark, sf, n) for n in names])


@query(
    oracle="""
select decision_id, decision_type, status, subject_id, summary, rationale, human_review_required,
       cast(evidence_count as bigint) as evidence_count
from decision_outcomes
where n_bad = 0 and evidence_count > 0 and len(field_errors) = 0 and problem is null and n_dangling = 0
""",
    **_DECISION_STEPS,
)
def q_assemble_decisions(spark, sf):
    return _assemble(spark, sf)[0]


@query(
    oracle="""
select i.decision_id, result_index, item_index, evidence_id, fal_version, ontology_version,
       profile_version, source_hash, resource_uri
from ranked_items i join decision_outcomes d on i.decision_id = d.decision_id
where rn = 1 and n_bad = 0 and len(field_errors) = 0 and problem is null and n_dangling = 0
""",
    **_DECISION_STEPS,
)
def q_assembled_evidence(spark, sf):
    return _assemble(spark, sf)[1]


@query(
    oracle="""
select decision_id, severity, code, path from unsuccessful
union all select decision_id, severity, code, path from conflicts
union all
select decision_id, 'ERROR', 'GOVERNANCE_EVIDENCE_REQUIRED', '$.evidenceResults'
from decision_outcomes where n_bad = 0 and evidence_count = 0
union all
select decision_id, 'ERROR', 'GOVERNANCE_RESULT_INVALID', unnest(field_errors)
from decision_outcomes where n_bad = 0 and evidence_count > 0
union all
select decision_id, 'ERROR', 'GOVERNANCE_RESULT_INVALID', '$'
from decision_outcomes where n_bad = 0 and evidence_count > 0 and len(field_errors) = 0
  and (problem is not null or n_dangling > 0)
""",
    **_DECISION_STEPS,
)
def q_assembly_findings(spark, sf):
    return _assemble(spark, sf)[2]


@query(
    oracle="""
select manifest_id as subject_id, 'ERROR' as severity, split_part(p, '|', 1) as code,
       '$.sources.' || entry_index || split_part(p, '|', 2) as path, 0 as check_order,
       'manifest' as check_name
from (select manifest_id, entry_index, unnest(problems) as p from checked_entries) x
union all
select manifest_id, 'ERROR', 'MANIFEST_CONTRACT_INVALID', contract_path, 0, 'manifest'
from manifest_states where contract_path is not null
union all
select entry_id, 'ERROR', split_part(p, '|', 1), split_part(p, '|', 2), 1, 'evidence'
from (select entry_id, unnest(problems) as p from usable_provenance) x
union all
select row_key, 'ERROR', 'PAYLOAD_VALIDATION_ERROR', unnest(errors), 2, 'contract'
from occurrence_errors
""",
    **_MANIFEST_STEPS, **_PROVENANCE_STEPS, **_OCC_STEPS,
)
def q_union_findings(spark, sf):
    return dc.union_findings(
        [
            ("manifest", _check(spark, sf).findings),
            ("evidence", q_evidence_build_findings(spark, sf)),
            ("contract", q_validate_contract(spark, sf)),
        ]
    )


@query(oracle="""
select g.name, case when c.name is null then 'missing' else 'different' end as drift
from generated_artifacts g left join committed_artifacts c on g.name = c.name
where c.name is null or c.content <> g.content
""")
def q_snapshot_drift(spark, sf):
    return dc.snapshot_drift(
        bind(spark, sf, "generated_artifacts"), bind(spark, sf, "committed_artifacts")
    )
