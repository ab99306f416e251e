"""Inputs of the registered queries, derived from the driver tables.

The driver's tables are a retail star schema, so every query first derives workbooks, manifests,
authorizations and results from them. A derivation is one SQL text that Spark and the checking
database both run; faults are injected by key arithmetic over the whole table. Derivations refer
to each other by name and to driver tables as `{table}`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from steward.operators.normalize import MappedColumn, MappingSpec
from steward.sources.grid import cells_of, leading_row, melt_to_rows, raw_cell

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

BINDINGS: dict[str, str] = {}

# --- FILES: manifests and the files they list, from documents -----------------------------------

BINDINGS["doc_files"] = """
select doc_id, source, text,
       source || '-' || cast(cast(floor(doc_id / 400) as bigint) as string) as manifest_id,
       source || '/' || cast(doc_id as string) || '.txt' as file_path,
       case when right(source, 1) in ('1', '3', '5', '7', '9') then 1 else 0 end as faulty
from {documents}
"""
BINDINGS["file_digests"] = """
select file_path as path, cast(octet_length(text) as bigint) as length,
       sha2(text, 256) as sha256
from doc_files where doc_id % 37 <> 0 or faulty = 0
"""
BINDINGS["manifest_entries"] = """
select manifest_id, doc_id as entry_index,
       case when (faulty = 1 and doc_id % 13 = 0) or (source = 'src2' and doc_id % 3 = 0)
              then 'SRC-SHARED'
            when faulty = 1 and doc_id % 47 = 0 then ''
            else 'SRC-' || cast(doc_id as string) end as source_id,
       'FALTEST' as fal_version, '0.0.0-test' as ontology_version,
       case when faulty = 1 and doc_id % 61 = 0 then cast(null as string)
            else 'profile-0.0.0-test' end as profile_version,
       case when faulty = 1 and doc_id % 29 = 0 then '/' || file_path
            when faulty = 1 and doc_id % 31 = 0 then '../' || file_path
            when faulty = 1 and doc_id % 53 = 0 then 'C:\\\\' || file_path
            else file_path end as source_file,
       case when faulty = 1 and doc_id % 17 = 0 then sha2(text || 'x', 256)
            when faulty = 1 and doc_id % 19 = 0 then upper(sha2(text, 256))
            when faulty = 1 and doc_id % 23 = 0 then 'sha256:' || sha2(text, 256)
            else sha2(text, 256) end as source_hash,
       'urn:test:source:' || cast(doc_id as string) as resource_uri,
       faulty = 1 and doc_id % 41 = 0 as has_forbidden_field
from doc_files
"""
BINDINGS["manifests"] = """
select manifest_id,
       case when manifest_id like 'src8-%' then 0 else 1 end as version,
       manifest_id like 'src1-%' or manifest_id like 'src3-%' as pending_shape
from doc_files group by manifest_id
"""
BINDINGS["workbook_files"] = """
select 'WB-' || cast(doc_id as string) as workbook_id, manifest_id,
       case when doc_id % 67 = 0 then 'elsewhere/' || file_path else file_path end as path
from doc_files
"""
BINDINGS["provenance_entries"] = """
select 'E-' || cast(entry_index as string) as entry_id, source_id, fal_version, ontology_version,
       profile_version, source_file, source_hash, resource_uri,
       entry_index % 7 <> 0 as verified,
       case when entry_index % 11 = 0 then 'review_required' when entry_index % 59 = 0 then 'done'
            else 'approved' end as status
from manifest_entries
"""

# --- CELLS: two sheets per workbook, from customer and orders -----------------------------------

BINDINGS["grid_rows"] = """
select 0 as sheet_ordinal, c_custkey as k, c_name as txt, c_acctbal as amount,
       cast(null as timestamp) as dt, c_mktsegment as category from {customer}
union all
select 1 as sheet_ordinal, o_orderkey as k, o_orderstatus as txt, o_totalprice as amount,
       o_orderdate as dt, o_orderpriority as category from {orders}
"""
# Workbooks with w % 25 in (6, 7, 15, 18) hold no formula and no error cell.
BINDINGS["grid"] = """
select 'WB-' || cast(w as string) as workbook_id, w, sheet_ordinal, k, n, t,
       n + 2 + t as row_ordinal,
       case when k % 53 = 0 then cast(null as double) else cast(k as double) end as c1_number,
       case when k % 53 = 0 or k % 13 = 0 then cast(null as string) when k % 43 = 0 then '   '
            when k % 37 = 0 then '  ' || txt || '  ' else txt end as c2_text,
       kind as c3_type,
       case when k % 53 = 0 then cast(null as string) when kind = 'f' then '=SUM(1,2)'
            when kind = 'e' then '#DIV/0!' end as c3_text,
       case when k % 53 <> 0 and kind = 'n' then amount end as c3_number,
       case when k % 53 <> 0 and kind = 'b' then k % 2 = 0 end as c3_boolean,
       case when k % 59 = 0 then 's' else 'd' end as c4_type,
       case when k % 53 <> 0 and k % 59 = 0 and sheet_ordinal = 1 then '2020-01-02' end as c4_text,
       case when k % 53 <> 0 and k % 59 <> 0 then dt end as c4_time,
       case when k % 47 = 0 then 'x' when k % 3 = 0 then 'inlineStr' else 's' end as c5_type,
       case when k % 53 <> 0 then category end as c5_text
from (
  select *, case when w % 5 = 0 then 1 else 0 end as t,
         case when k % 29 = 0 and w % 25 not in (6, 7, 15, 18) then 'f'
              when k % 31 = 0 and w % 25 not in (6, 7, 15, 18) then 'e'
              when k % 41 = 0 then 'b' else 'n' end as kind
  from (
    select *, cast(floor(k / 1000000) as bigint) * 25 + k % 25 as w,
           cast(floor((k % 1000000) / 25) as bigint) as n
    from grid_rows) placed) titled
"""
BINDINGS["sheet_structure"] = """
select workbook_id, w, sheet_ordinal,
       'SHEET-' || cast(w as string) || '-' || cast(sheet_ordinal as string) as sheet_name,
       case when (w + sheet_ordinal) % 9 = 4 then 'hidden'
            when (w + sheet_ordinal) % 10 = 1 then 'veryHidden' else 'visible' end as state,
       real_rows * (case when w % 6 = 0 then 20 else 1 end) as declared_rows,
       case when sheet_ordinal = 2 then 0 else 5 end as declared_columns,
       cast(case when sheet_ordinal = 2 then 0 else w % 4 end as int) as merged_range_count,
       cast(w % 2 as int) as hidden_row_count, cast(w % 3 as int) as hidden_column_count,
       cast(case when sheet_ordinal = 2 then 0 else w % 5 end as int) as hyperlink_count,
       cast(case when sheet_ordinal = 2 then 0 else w % 6 end as int) as data_validation_count,
       cast(case when sheet_ordinal = 2 and w % 17 <> 3 then 0 else w % 3 end as int) as table_count,
       cast(w % 3 as int) as drawing_count,
       cast(case when sheet_ordinal = 2 then 0 else w % 7 end as int) as comment_count,
       w % 13 = 0 as has_sheet_protection,
       case when w % 8 = 0 and sheet_ordinal < 2 then 1 else 0 end as merged_top_rows
from (
  select workbook_id, w, sheet_ordinal, max(row_ordinal) as real_rows
  from grid group by workbook_id, w, sheet_ordinal
  union all
  select workbook_id, w, 2 as sheet_ordinal, cast(0 as bigint) as real_rows
  from grid where n = 0 and sheet_ordinal = 0) sheets
"""
BINDINGS["workbooks"] = """
select workbook_id, w, cast(case when w % 23 = 0 then 1 else 0 end as int) as skipped_part_count,
       w % 19 = 0 as has_workbook_protection, w % 3 <> 2 as provenance_verified
from grid where n = 0 and sheet_ordinal = 0
"""

SCAN_ROWS, SCAN_COLUMNS = 500, 5

SHEET_SPEC = MappingSpec(
    dataset_id="TEST-DATASET-001",
    sheet_ordinal=1,
    header_row=2,
    first_data_row=3,
    columns=(
        MappedColumn(1, "record_key", True, "integer"),
        MappedColumn(2, "record_name", True, "string"),
        MappedColumn(3, "amount", False, "number"),
        MappedColumn(4, "order_date", True, "date"),
        MappedColumn(5, "category", False, "string"),
    ),
)

HEADERS = ("Key", "Name", "Amount", "Date", "Category")


def _header_cells() -> list[str]:
    """Header variety by workbook number."""
    cells = []
    for i, name in enumerate(HEADERS, start=1):
        numeric = f"(w % 11 = 0 OR (w % 7 = 0 AND {i in (1, 3)}))"
        text = f"CASE WHEN w % 4 = 0 AND {i == 5} THEN ' Name ' ELSE '{name}' END"
        cells.append(
            raw_cell(
                f"CASE WHEN {numeric} THEN 'n' ELSE 's' END",
                text=f"CASE WHEN NOT {numeric} THEN {text} END",
                number=f"CASE WHEN {numeric} THEN {float(i)} END",
            )
        )
    return cells


GRID_COLUMNS = {
    "c1": raw_cell("'n'", number="c1_number"),
    "c2": raw_cell("'s'", text="c2_text"),
    "c3": raw_cell("c3_type", text="c3_text", number="c3_number", boolean="c3_boolean"),
    "c4": raw_cell("c4_type", text="c4_text", time="c4_time"),
    "c5": raw_cell("c5_type", text="c5_text"),
}


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of both sheets by rows, title and header rows included."""
    title = leading_row("1", [raw_cell("'s'", text="'TEST TITLE'"), *[raw_cell("'n'")] * 4])
    header = leading_row("1 + t", _header_cells())
    leading = F.expr(
        f"CASE WHEN n = 0 AND t = 1 THEN array({title}, {header}) "
        f"WHEN n = 0 THEN array({header}) END"
    )
    return melt_to_rows(bind(spark, sf_dir, "grid"), GRID_COLUMNS, leading_rows=leading)


def cells(spark: SparkSession, sf_dir: str, classify: bool = True) -> DataFrame:
    """The same grid cell by cell."""
    return cells_of(grid(spark, sf_dir), classify=classify)


_CELL_TYPE = """
case when value_string is null and value_number is null and value_boolean is null
          and value_timestamp is null then 'blank'
     when raw_type = 'f' then 'formula' when raw_type = 'e' then 'error'
     when raw_type = 'b' then 'boolean' when raw_type = 'd' and value_string is null then 'date'
     when raw_type = 'n' then 'number' when raw_type = 'inlineStr' then 'inline_string'
     when raw_type in ('s', 'str') then 'string' else 'unknown' end
"""


def _oracle_cells() -> dict[str, str]:
    """The same grid for the checking database: one SELECT per column and kind of row."""
    null = {"text": "cast(null as varchar)", "number": "cast(null as double)",
            "boolean": "cast(null as boolean)", "time": "cast(null as timestamp)"}
    data = [
        ("'n'", {"number": "c1_number"}),
        ("'s'", {"text": "c2_text"}),
        ("c3_type", {"text": "c3_text", "number": "c3_number", "boolean": "c3_boolean"}),
        ("c4_type", {"text": "c4_text", "time": "c4_time"}),
        ("c5_type", {"text": "c5_text"}),
    ]
    selects = []

    def add(row: str, column: int, kind: str, values: dict[str, str], where: str) -> None:
        v = {**null, **values}
        selects.append(
            f"select workbook_id, sheet_ordinal, cast({row} as bigint) as row_ordinal, "
            f"{column} as column_ordinal, {kind} as raw_type, {v['text']} as value_string, "
            f"{v['number']} as value_number, {v['boolean']} as value_boolean, "
            f"{v['time']} as value_timestamp from grid where {where}"
        )

    for i, (kind, values) in enumerate(data, start=1):
        add("row_ordinal", i, kind, values, "true")
        numeric = f"(w % 11 = 0 or (w % 7 = 0 and {i} in (1, 3)))"
        text = f"case when w % 4 = 0 and {i} = 5 then ' Name ' else '{HEADERS[i - 1]}' end"
        header = {"text": f"case when not {numeric} then {text} end",
                  "number": f"case when {numeric} then cast({i} as double) end"}
        add("1 + t", i, f"case when {numeric} then 'n' else 's' end", header, "n = 0")
        title = {"text": "'TEST TITLE'"} if i == 1 else {}
        add("1", i, "'s'" if i == 1 else "'n'", title, "n = 0 and t = 1")
    return {
        "raw_cells": "\nunion all ".join(selects),
        "cells": f"select *, {_CELL_TYPE} as cell_type from raw_cells",
    }


# --- AUTH: reports and authorizations, from orders and lineitem ---------------------------------
# A report covers eight consecutive orders (its sheets); a line item is one of its findings.
# Reports with r % 4 = 0 carry no injected faults.

BINDINGS["auth_sheets_base"] = """
select *, cast(o_orderkey % 8 as int) as s, case when r % 4 = 0 then 1 else 0 end as clean,
       'AUTH-' || cast(r as string) as authorization_id
from (select *, cast(floor(o_orderkey / 8) as bigint) as r from {orders}) o
"""
BINDINGS["reports"] = """
select authorization_id, r,
       case when clean = 0 and r % 53 = 1 then 2 else 1 end as report_version,
       not (clean = 0 and r % 59 = 1) as provenance_verified,
       case when clean = 0 and r % 61 = 1 then 'pending' else 'verified' end as manifest_status,
       'verified-source' as inspection_mode,
       not (clean = 0 and r % 67 = 1) as inspection_completed,
       'SRC-' || cast(r as string) as source_id,
       'REPORT-' || cast(r as string) as report_text
from auth_sheets_base where s = 0
"""
BINDINGS["report_sheets"] = """
select authorization_id, o_orderkey as sheet_index,
       case when clean = 0 and o_orderkey % 101 = 7 then -1
            when clean = 0 and o_orderkey % 97 = 5 and s > 0 then s - 1 else s end as sheet_ordinal,
       case when o_custkey % 10 = 9 then cast(null as int)
            else cast(1 + o_custkey % 3 as int) end as inferred_header_row,
       case when o_custkey % 10 = 9 then 'none' when o_orderstatus = 'O' then 'medium'
            else 'high' end as header_confidence
from auth_sheets_base
"""
BINDINGS["auth_lines"] = """
select l.*, 'AUTH-' || cast(r as string) as authorization_id,
       case when r % 4 = 0 then 1 else 0 end as clean,
       case when r % 4 = 0
            then cast(l_orderkey % 8 + 8 * cast(floor(l_linenumber / 4) as bigint) as int)
            else cast(l_orderkey % 8 as int) end as s,
       l_linenumber + 8 * cast(round(l_extendedprice * 100) as bigint) as finding_index,
       case when r % 4 = 0 then 3 + l_linenumber % 4
            else (l_partkey + l_linenumber) % 12 end as code_number
from (select *, cast(floor(l_orderkey / 8) as bigint) as r from {lineitem}) l
"""
BINDINGS["auth_lines_distinct"] = """
select authorization_id, r, clean, s, code_number, l_linenumber, l_orderkey,
       min(finding_index) as finding_index, max(l_partkey) as l_partkey
from auth_lines where clean = 1
group by authorization_id, r, clean, s, code_number, l_linenumber, l_orderkey
union all
select authorization_id, r, clean, s, code_number, l_linenumber, l_orderkey, finding_index,
       l_partkey
from auth_lines where clean = 0
"""
_CODE = """
       case code_number
         when 0 then 'WORKBOOK_SCAN_LIMIT_REACHED' when 1 then 'WORKBOOK_HEADER_NOT_DETECTED'
         when 2 then 'WORKBOOK_XML_PART_SCAN_SKIPPED'
         when 3 then 'WORKBOOK_DECLARED_DIMENSION_EXCESSIVE' when 4 then 'WORKBOOK_PROTECTION_ENABLED'
         when 5 then 'WORKBOOK_CUSTOM_XML_PRESENT' when 6 then 'WORKBOOK_DIGITAL_SIGNATURE_PRESENT'
         when 7 then 'WORKBOOK_EMPTY_SHEET' when 8 then 'WORKBOOK_DRAWING_ONLY_SHEET'
         when 9 then 'WORKBOOK_FORMULA_PRESENT' when 10 then 'WORKBOOK_HIDDEN_SHEET_PRESENT'
         else 'WORKBOOK_CELL_ERROR_PRESENT' end as code"""
BINDINGS["report_findings"] = f"""
select authorization_id, finding_index,
       case when clean = 0 and l_partkey % 83 = 0 then 'ERROR' else 'WARNING' end as severity,
       {_CODE},
       case when clean = 0 and l_linenumber = 7 then '$.workbook'
            when clean = 0 and l_linenumber = 6 then cast(null as string)
            else '$.sheets.' || cast(s as string)
                 || (case when l_linenumber = 2 then '.rows.1' else '' end) end as path
from auth_lines_distinct
"""
BINDINGS["finding_keys_raw"] = f"""
select 'AUTH-' || cast(r as string) as authorization_id, r, clean, {_CODE}, code_number,
       sheet_ordinal
from (select distinct r, clean, code_number,
             case when clean = 1 or l_linenumber < 6 then s end as sheet_ordinal
      from auth_lines) k
"""
BINDINGS["acks"] = """
select authorization_id, code, sheet_ordinal,
       case when clean = 0 and (r + coalesce(sheet_ordinal, 5)) % 13 = 0 then 'remains_blocking'
            else 'accepted_for_reviewed_scope' end as disposition,
       case when clean = 0 and r % 89 = 2 and sheet_ordinal = 3 then 'lower_reason'
            else 'TEST_REASON_001' end as reason_code
from finding_keys_raw
where clean = 1 or (r + coalesce(sheet_ordinal, 9) + code_number) % 11 <> 0
union all
select authorization_id, 'WORKBOOK_EMPTY_SHEET' as code, 100 + s as sheet_ordinal,
       'resolved' as disposition, 'TEST_REASON_002' as reason_code
from auth_sheets_base where clean = 0 and o_orderkey % 37 = 0
union all
select authorization_id, 'WORKBOOK_EMPTY_SHEET' as code, cast(null as int) as sheet_ordinal,
       'resolved' as disposition, 'TEST_REASON_003' as reason_code
from auth_sheets_base where clean = 0 and r % 71 = 3 and s < 2
"""
BINDINGS["auth_sheets"] = """
select authorization_id,
       o_orderkey as sheet_index,
       case when clean = 0 and o_orderkey % 103 = 3 then 50 + s
            when clean = 0 and o_orderkey % 331 = 5 and s > 0 then s - 1 else s end as sheet_ordinal,
       classification,
       classification = 'data_table' and not (clean = 0 and o_orderkey % 211 = 0) as normalize,
       case when classification = 'data_table'
            then case when clean = 0 and o_orderkey % 41 = 0 then 9
                      else cast(1 + o_custkey % 3 as int) end
            when clean = 0 and o_orderkey % 223 = 0 then 1 end as header_row,
       case when classification <> 'data_table' then 'none'
            when clean = 0 and o_orderkey % 227 = 0 then 'low'
            when clean = 0 and o_orderkey % 59 = 0 then 'high'
            when o_orderstatus = 'O' then 'medium' else 'high' end as header_confidence,
       classification = 'data_table' and o_orderstatus = 'O'
         and not (clean = 0 and o_orderkey % 229 = 0) as medium_confidence_approved,
       case when classification in ('metadata_or_readme', 'excluded_non_data')
                 and not (clean = 0 and o_orderkey % 233 = 0) then 'TEST_EXCLUSION_001'
            when clean = 0 and o_orderkey % 239 = 0 then 'bad code' end as exclusion_reason_code
from (select *, case when o_custkey % 10 = 9 then 'metadata_or_readme'
                     when clean = 1 then 'data_table'
                     when o_orderkey % 307 = 0 then 'diagram'
                     when o_custkey % 10 = 8 then 'model_reference'
                     when o_custkey % 10 = 7 then 'excluded_non_data'
                     when o_custkey % 10 = 6 then 'code_list'
                     else 'data_table' end as classification
      from auth_sheets_base) b
"""
BINDINGS["reviews"] = """
select authorization_id, sheet_ordinal,
       case (r + sheet_ordinal) % 5 when 0 then 'documentation' when 1 then 'out_of_scope_visual'
            when 4 then 'undecided' else 'imo_compendium_model_reference'
            end as drawing_review_category,
       (r + sheet_ordinal) % 6 <> 0 as completed, r % 5 <> 0 as reference_model_alignment_approved,
       r % 6 <> 0 as model_reference_scope_approved,
       r % 7 <> 0 as model_reference_reviewer_recorded,
       case when r % 8 = 1 then cast(null as string) when clean = 0 and r % 97 = 2 then 'x'
            else 'TEST-REVIEW-001' end as evidence_reference_id,
       r % 9 <> 0 as external_verification_asserted,
       r % 10 = 1 as external_verification_technically_confirmed
from finding_keys_raw
where code_number = 8 and sheet_ordinal is not null
      and (r + sheet_ordinal) % 4 <> 0
union all
select authorization_id, 200 + s as sheet_ordinal, 'documentation' as drawing_review_category,
       true as completed, false as reference_model_alignment_approved,
       false as model_reference_scope_approved, false as model_reference_reviewer_recorded,
       cast(null as string) as evidence_reference_id, false as external_verification_asserted,
       false as external_verification_technically_confirmed
from auth_sheets_base where clean = 0 and o_orderkey % 43 = 0
"""
BINDINGS["authorizations"] = """
select authorization_id, r,
       case when clean = 0 and r % 109 = 1 then 0 else 1 end as version,
       case when clean = 0 and r % 47 = 1 then 'SRC-OTHER'
            else 'SRC-' || cast(r as string) end as source_id,
       case when clean = 0 and r % 43 = 1 then sha2(authorization_id, 256)
            when clean = 0 and r % 113 = 2 then upper(sha2('REPORT-' || cast(r as string), 256))
            else sha2('REPORT-' || cast(r as string), 256) end as inspection_report_id,
       'internal-restricted' as output_storage_class,
       case when clean = 0 and r % 127 = 2 then 'root'
            else 'ROOT-' || cast(r % 7 as string) end as approved_output_root_id,
       r % 12 <> 4 as human_review_completed
from auth_sheets_base where s = 0
"""
BINDINGS["output_bindings"] = """
select authorization_id, case when clean = 0 and r % 131 = 2 then 0 else 1 end as version,
       case when clean = 0 and r % 31 = 0 then 'ROOT-X' else 'ROOT-' || cast(r % 7 as string)
            end as root_id,
       'internal-restricted' as storage_class,
       case when clean = 0 and r % 137 = 2 then 'restricted/root' || cast(r % 7 as string)
            else '/restricted/root' || cast(r % 7 as string) end as root_path,
       case when clean = 0 and r % 29 = 1 then '/restricted/root' || cast(r % 7 as string) || 'x/out'
            when clean = 0 and r % 37 = 5 then '/restricted/root' || cast(r % 7 as string) || '/../../etc'
            when clean = 0 and r % 41 = 6 then '/restricted/root' || cast(r % 7 as string) || '/../root' || cast((r + 1) % 7 as string)
            when r % 5 = 2 then '/restricted/root' || cast(r % 7 as string) || '/draft/../out'
            when r % 3 = 0 then '/restricted/root' || cast(r % 7 as string)
            else '/restricted//root' || cast(r % 7 as string) || '/out' end as output_dir
from auth_sheets_base where s = 0
"""
BINDINGS["mapping_requests"] = """
select 'SPEC-' || cast(o_orderkey as string) as spec_id, authorization_id,
       case when o_orderkey % 19 = 0 then 300 else s end as source_sheet_ordinal,
       case when o_orderkey % 23 = 0 then 7 else cast(1 + o_custkey % 3 as int) end as header_row
from auth_sheets_base
"""
BINDINGS["mapping_columns"] = """
select 'SPEC-' || cast(l_orderkey as string) as spec_id,
       cast(l_orderkey % 3 as int) + 1 as header_row,
       cast(l_orderkey % 3 as int) + (case when l_orderkey % 13 = 0 then 1 else 2 end)
         as first_data_row,
       l_linenumber as source_column_ordinal,
       'field_' || (case when l_linenumber = 7 and l_orderkey % 17 = 0 then '1'
                         else cast(l_linenumber as string) end) as target_field
from (select distinct l_orderkey, l_linenumber,
             case when l_orderkey % 5 = 0 then l_partkey else 0 end as twin from {lineitem}) d
"""

# --- RESULTS: results, evidence and decisions, from events --------------------------------------

BINDINGS["event_rows"] = """
select *, 'R-' || cast(user_id as string) || '-' || cast(cast(ts as date) as string) as result_id,
       'D-' || cast(user_id as string) as decision_id
from {events}
"""
BINDINGS["result_findings"] = """
select result_id, event_id as finding_index,
       case when event_type = 'error' then 'errors' else 'warnings' end as list_name,
       case when event_id % 61 = 0 then 'WARNING' when event_id % 67 = 0 then 'ERROR'
            when event_type = 'error' then 'ERROR' else 'WARNING' end as severity,
       'VAL_TEST_' || cast(event_id % 10 as string) as code
from event_rows where event_type in ('error', 'view')
"""
BINDINGS["result_refs"] = """
select result_id, event_id as finding_index, 'evidence:' || cast(event_id % 53 as string) as ref
from event_rows where event_type in ('error', 'view')
"""
BINDINGS["result_evidence"] = """
select result_id, event_id as item_index, 'evidence:' || cast(event_id % 50 as string) as evidence_id
from event_rows where event_type in ('click', 'signup', 'purchase')
"""
BINDINGS["results"] = """
select result_id,
       case when d % 11 = 0 then 'PASS' when d % 13 = 0 then 'FAIL' when d % 17 = 0 then 'WARNING'
            when n_errors > 0 then 'FAIL' when n_warnings > 0 then 'WARNING' else 'PASS' end as status,
       case when d % 7 = 0 then false else n_errors + n_warnings > 0 end as human_review_required
from (select result_id, max(event_id) as d, count(*) as n,
             cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as n_errors,
             cast(sum(case when event_type = 'view' then 1 else 0 end) as bigint) as n_warnings
      from event_rows group by result_id) c
"""
BINDINGS["decisions"] = """
select decision_id, case when u % 31 = 0 then 'UNKNOWN' else 'DATA_QUALITY' end as decision_type,
       case u % 3 when 0 then 'APPROVED' when 1 then 'REVIEW_REQUIRED' else 'REJECTED' end as status,
       case when u % 37 = 0 then '' else 'SUBJECT-' || cast(u as string) end as subject_id,
       'summary' as summary, 'rationale' as rationale,
       case when u % 3 = 0 then u % 15 = 0 else u % 14 <> 1 end as human_review_required
from (select distinct decision_id, user_id as u from event_rows) d
"""
BINDINGS["decision_findings"] = """
select decision_id, event_id as finding_index,
       case when user_id % 3 = 2 or event_id % 241 = 0 then 'ERROR' else 'WARNING' end as severity,
       'VAL_TEST_' || cast(event_id % 10 as string) as code
from event_rows where event_type = 'error' and (user_id % 3 <> 0 or event_id % 5 = 0)
"""
BINDINGS["decision_refs"] = """
select decision_id, finding_index, evidence_id as ref from (
  select f.decision_id, f.finding_index,
         case when f.finding_index % 143 = 0 then 'evidence:none' else e.first_id end as evidence_id
  from decision_findings f
  join (select decision_id, min(evidence_id) as first_id from evidence_items group by decision_id) e
    on f.decision_id = e.decision_id) r
"""
BINDINGS["source_results"] = """
select decision_id, event_id as result_index,
       case when event_id % 89 = 0 and user_id % 4 = 2 then 'FAIL' else 'PASS' end as status
from event_rows where event_type = 'view'
"""
BINDINGS["evidence_results"] = """
select decision_id, event_id as result_index,
       case when event_id % 97 = 0 and user_id % 5 = 1 then 'WARNING' else 'PASS' end as status,
       event_id % 101 = 0 and user_id % 5 = 2 as has_errors
from event_rows where event_type in ('click', 'signup', 'purchase') and user_id % 29 <> 5
"""
BINDINGS["evidence_items"] = """
select decision_id, event_id as result_index, cast(part_no as bigint) as item_index,
       'evidence:' || cast((event_id + part_no) % 50 as string) as evidence_id,
       'FALTEST' as fal_version, '0.0.0-test' as ontology_version, 'profile' as profile_version,
       sha2(cast((event_id + part_no) % 50 as string)
            || (case when event_id % 71 = 0 and user_id % 4 = 1 then 'x' else '' end), 256) as source_hash,
       case when ((event_id + part_no) % 50) % 4 = 0 then cast(null as string) else 'urn:test' end as resource_uri
from (select decision_id, user_id, event_id, event_type, 0 as part_no from event_rows
      union all
      select decision_id, user_id, event_id, event_type, 1 as part_no from event_rows
      where event_id % 3 = 0) p
where event_type in ('click', 'signup', 'purchase') and (event_id % 103 <> 0 or user_id % 5 <> 3) and user_id % 29 <> 5
"""

# --- OCC: ontology rows, from lineitem ----------------------------------------------------------

BINDINGS["occurrences"] = """
select case when l_partkey % 41 = 0 then '' else 'occ-' || cast(l_orderkey as string) || '-'
            || cast(l_linenumber as string) end as occurrence_id,
       case when l_suppkey % 43 = 0 then cast(null as string)
            else 'ds-' || cast(l_suppkey as string) end as dataset_id,
       'EL-' || cast(l_partkey as string) as element_imo_id,
       case when l_quantity < 5 then cast(null as string)
            else 'TEST/PATH/' || cast(l_partkey as string) end as technical_position,
       cast(null as string) as parent_component_id,
       l_linenumber - (case when l_partkey % 47 = 0 then 7 else 0 end) as sequence,
       cast(null as string) as cardinality, l_linestatus as usage,
       case when l_partkey % 53 = 0 then 'rejected' when l_returnflag = 'A' then 'approved'
            when l_returnflag = 'R' then 'review_required' else cast(null as string) end as status,
       'L-' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) as row_key
from {lineitem}
"""

# --- JSON: documents with shape faults, from events.props ---------------------------------------

BINDINGS["json_docs"] = """
select event_id as doc_id,
       case when event_id % 11 = 0 then substr(props, 1, length(props) - 1)
            when event_id % 13 = 0 then '[' || props || ']'
            when event_id % 17 = 0 then substr(props, 1, length(props) - 1) || ', "extra": 1}'
            when event_id % 19 = 0 then '"text"'
            when event_id % 23 = 0 then 'null'
            when event_id % 29 = 0 then props || ' trailing'
            when event_id % 31 = 0 then '{"k": {"k": 1}, "other": null, "status": "x"}'
            else props end as doc
from {events}
"""
BINDINGS["schema_docs"] = """
select event_id as doc_id,
       case when event_id % 2 = 0 then 'ontology' else 'validation' end as schema_name,
       case when event_id % 11 = 0 then substr(props, 1, length(props) - 1)
            when event_id % 13 = 0 then props
            when event_id % 17 = 0 then '{"$defs": [' || props || ']}'
            when event_id % 2 = 0 then
              '{"title": ' || props || ', "$defs": {'
              || (case when event_id % 19 = 0 then '"Other": {}' else '"DataElement": {"properties": {}}' end)
              || (case when event_id % 23 = 0 then '' else ', "ElementOccurrence": {"properties": {'
                    || (case when event_id % 29 = 0 then '"other": {}' else '"element_imo_id": {}' end)
                    || (case when event_id % 31 = 0 then ', "elementImoId": {"type": "string"}' else '' end)
                    || '}}' end)
              || '}}'
            else
              '{"$defs": {"SkillResult": '
              || (case when event_id % 37 = 0 then '"text"'
                       when event_id % 41 = 0 then '{}'
                       when event_id % 43 = 0 then '{"properties": {"humanReviewRequired": {}, "human_review_required": {}}}'
                       when event_id % 47 = 0 then replace('"{#"properties#": {#"humanReviewRequired#": {}}}"', '#', chr(92))
                       when event_id % 53 = 0 then '{"properties": {"humanReviewRequired": {}}, "properties": {}}'
                       else '{"properties": {"humanReviewRequired": ' || props || '}}' end)
              || '}}' end as doc
from {events}
"""

# --- SNAP: generated and committed artifacts, from orders ---------------------------------------

BINDINGS["generated_artifacts"] = """
select 'artifact-' || cast(o_orderkey as string) as name,
       o_orderstatus || '|' || o_orderpriority || '|' || cast(o_custkey as string) as content
from {orders}
"""
BINDINGS["committed_artifacts"] = """
select 'artifact-' || cast(o_orderkey as string) as name,
       o_orderstatus || '|' || o_orderpriority || '|' || cast(o_custkey as string)
         || (case when o_orderkey % 101 = 0 then ' ' else '' end) as content
from {orders} where o_orderkey % 97 <> 0
union all
select 'extra-' || cast(o_orderkey as string) as name, 'x' as content
from {orders} where o_orderkey % 89 = 0
"""

# --- PARTS: container entries and workbook XML, from pages --------------------------------------

BINDINGS["page_entries"] = """
select page_id, url, html, cast(floor(page_id / 12) as bigint) as g,
       cast(page_id % 12 as int) as slot,
       'WB-' || cast(cast(floor(page_id / 12) as bigint) as string) as workbook_id
from {pages}
"""
BINDINGS["parts"] = """
select workbook_id, page_id as entry_ordinal,
       case when slot = 0 and g % 9 <> 5 then '[Content_Types].xml'
            when slot = 1 then 'xl/workbook.xml' when slot = 2 then 'xl/_rels/workbook.xml.rels'
            when slot = 3 and g % 5 = 1 then 'xl/vbaProject.bin'
            when slot = 4 and g % 6 = 1 then 'xl/externalLinks/externalLink1.xml'
            when slot = 5 and g % 7 = 2 then 'xl/embeddings/oleObject1.bin'
            when slot = 6 and g % 8 = 3 then 'xl/activeX/activeX1.xml'
            when slot = 7 and g % 3 = 0 then 'customXml/item1.xml'
            when slot = 8 and g % 4 = 0 then '_xmlsignatures/sig1.xml'
            when slot = 9 then 'xl/drawings/' || (case when g % 2 = 0 then '_rels/' else '' end)
                               || 'drawing1.xml'
            when slot = 10 then 'xl/comments' || cast(g % 3 as string) || '.xml'
            when slot = 11 and g % 10 = 3 then '../evil.xml'
            when slot = 11 and g % 10 = 7 then 'xl/workbook.xml'
            else regexp_extract(url, '^https?://[^/]+/(.*)$', 1) end as entry_name,
       cast(length(url) as bigint) as compress_size, cast(length(html) as bigint) as file_size,
       case when g % 11 = 4 and slot = 3 then 1 else 0 end as flag_bits,
       case when slot = 0 and g % 9 <> 5 then
              case when g % 13 = 6 then 'application/vnd.ms-excel.sheet.macroEnabled' else html end
            when slot = 2 then
              case when g % 14 = 8 then 'Type="http://x/externalLink" Type="http://y/externalLink"'
                   else html end
            end as text
from page_entries
"""
BINDINGS["sheet_xml_base"] = """
select *, cast(page_id % 7 as int) as a, cast(page_id % 5 as int) as b,
       cast(page_id % 3 as int) as c
from page_entries
"""
BINDINGS["sheet_xml"] = """
select workbook_id, 'xl/worksheets/sheet' || cast(slot as string) || '.xml' as entry_name, page_id,
       '<worksheet xmlns:r="urn:r"><dimension ref="A1:D' || cast(10 + a as string) || '"/>'
       || repeat('<cols><col min="1" hidden="1"/></cols>', b) || '<sheetData>'
       || repeat('<row r="1" hidden="true"/>', c) || '<row r="9"/></sheetData>'
       || (case when a = 3 then '<sheetProtection sheet="1"/>' else '' end)
       || '<mergeCells>' || repeat('<mergeCell ref="A2:B2"/>', a)
       || repeat('<mergeCell ref="A22:B22"/>', b) || '</mergeCells>'
       || repeat('<hyperlink ref="A1"/>', c) || repeat('<dataValidation type="list"/>', a)
       || repeat('<drawing r:id="rId1"/>', c) || repeat('<tablePart r:id="rId2"/>', b)
       || '</worksheet>' as text,
       a, b, c
from sheet_xml_base
"""


BINDINGS["book_sheets"] = """
select workbook_id, cast(slot as int) as sheet_ordinal, page_id,
       'Sheet ' || cast(page_id as string) as sheet_name,
       case page_id % 4 when 1 then 'hidden' when 2 then 'veryHidden' else 'visible' end as state,
       slot % 4 = 1 as commented
from page_entries
"""

# --- byte documents: YAML manifests of ten documents, workbooks of a hundred orders -------------

BINDINGS["yaml_items"] = """
select cast(floor(doc_id / 10) as bigint) as g, doc_id,
       '  - {source_id: "SRC-' || cast(doc_id as string) || '", fal_version: FALTEST, '
       || 'ontology_version: "0.0", profile_version: "p", source_file: "' || source || '/'
       || cast(doc_id as string) || '.txt", source_hash: "' || sha2(text, 256) || '"'
       || (case when doc_id % 41 = 0 then ', verified: true' else '' end)
       || (case when doc_id % 43 = 0 then ', colour: red' else '' end) || '}' as item
from {documents}
"""
BINDINGS["order_cells"] = """
select 'XW-' || cast(cast(floor(o_orderkey / 100) as bigint) as string) as workbook_id,
       o_orderkey as k, o_orderkey % 100 + 2 as r, o_totalprice as amount,
       o_orderstatus as status, o_orderpriority as priority, o_orderdate as day,
       case when o_orderkey % 29 = 0 then 'f' when o_orderkey % 31 = 0 then 'e'
            when o_orderkey % 37 = 0 then 'b' else 'n' end as kind
from {orders}
"""


# --- resolution -------------------------------------------------------------------------------

_NAME = re.compile(r"[a-z_][a-z0-9_]*")


def _dependencies(sql: str, known: dict[str, str]) -> list[str]:
    words = re.findall(r"\b(?:from|join)\s+([a-z_][a-z0-9_]*)", sql)
    return [w for w in dict.fromkeys(words) if w in known]


def with_clause(names: list[str], known: dict[str, str]) -> str:
    """`WITH` list of the named derivations and everything they use, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in _dependencies(known[name], known):
            visit(other)
        ordered.append(name)

    for name in names:
        visit(name)
    return "with " + ",\n".join(f"{n} as ({known[n].strip()})" for n in ordered)


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derivation as a Spark DataFrame over the parquet tables in `sf_dir`."""
    sql = f"{with_clause([name], BINDINGS)}\nselect * from {name}"
    for table in TABLES:
        sql = sql.replace("{" + table + "}", f"parquet.`{sf_dir}/{table}.parquet`")
    return spark.sql(sql)


def oracle_bindings() -> dict[str, str]:
    """All derivations in the checking database's spelling."""
    known = {**BINDINGS, **_oracle_cells()}
    return {name: to_duckdb(sql) for name, sql in known.items()}


def to_duckdb(sql: str) -> str:
    sql = re.sub(r"sha2\((.+?), 256\)", r"sha256(\1)", sql, flags=re.DOTALL)
    sql = sql.replace("octet_length(", "strlen(")
    for table in TABLES:
        sql = sql.replace("{" + table + "}", table)
    return sql.replace("'C:\\\\'", "'C:\\'")
