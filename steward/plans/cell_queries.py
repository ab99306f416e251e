"""Queries over text columns, the cell grid, normalization and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from steward.functions.cells import TYPED_FIELDS, classify_cell, normalize_value
from steward.functions.jsontext import canonical_json
from steward.functions.masking import mask_by_classification
from steward.functions.naming import alias_columns
from steward.functions.paths import (
    cell_path, escapes_base, is_absolute, loc_to_path, sheet_ordinal_from_path,
)
from steward.functions.text import digest_text, name_digest, normalized_length
from steward.operators import normalize as nz, profile as pf
from steward.plans.bindings import SCAN_COLUMNS, SCAN_ROWS, SHEET_SPEC, bind, cells, grid
from steward.plans.registry import query, table
from steward.schemas import CELL_CATEGORIES

#: A melted table needs no budget: every row of every sheet is read.
OPTIONS = pf.InspectionOptions()
#: A budget that some sheets exceed, for the rules about budgets.
TIGHT = pf.InspectionOptions(SCAN_ROWS, SCAN_COLUMNS)

_SPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def _collapsed(expression: str) -> str:
    return f"trim(regexp_replace({expression}, '{_SPACE}', ' ', 'g'))"


# --- scalar functions -----------------------------------------------------------------------------


@query(oracle=f"""
select doc_id, sha256({_collapsed('text')}) as text_digest from documents
""")
def q_digest_text(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", digest_text(F.col("text")).alias("text_digest"))


@query(oracle=f"""
select doc_id, cast(length({_collapsed('text')}) as int) as text_length from documents
""")
def q_normalized_length(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", normalized_length(F.col("text")).alias("text_length"))


@query(oracle="select p_partkey, sha256(p_name) as name_digest from part")
def q_name_digest(spark, sf):
    parts = table(spark, sf, "part")
    return parts.select("p_partkey", name_digest(F.col("p_name")).alias("name_digest"))


@query(oracle="""
select workbook_id, sheet_ordinal, row_ordinal, column_ordinal, cell_type,
       case when cell_type = 'inline_string' then 'string' else cell_type end as folded_type
from cells
""")
def q_classify_cell(spark, sf):
    raw = cells(spark, sf, classify=False)
    return raw.select(
        *nz.ROW, "column_ordinal", classify_cell().alias("cell_type"),
        classify_cell(fold_inline=True).alias("folded_type"),
    )


_REJECT = """
case when cell_type = 'blank' then null when cell_type = 'formula' then 'FORMULA_VALUE_PROHIBITED'
     when cell_type = 'error' then 'ERROR_CELL_PROHIBITED'
     when cell_type = 'unknown' then 'UNKNOWN_CELL_TYPE'
     when value_type = 'string' and cell_type in ('string', 'inline_string') then null
     when value_type = 'number' and cell_type = 'number' then null
     when value_type = 'integer' and cell_type = 'number'
          and value_number = floor(value_number) then null
     when value_type = 'boolean' and cell_type = 'boolean' then null
     when value_type = 'date' and cell_type = 'date' then null
     else 'VALUE_TYPE_MISMATCH' end
"""


@query(
    oracle="""
select workbook_id, sheet_ordinal, row_ordinal, column_ordinal, value_type, reject_code,
       case when reject_code is null and value_type = 'string'
            then nullif(trim(value_string), '') end as value_string,
       case when reject_code is null and value_type = 'number' then value_number end as value_number,
       case when reject_code is null and value_type = 'integer'
            then cast(value_number as bigint) end as value_integer,
       case when reject_code is null and value_type = 'boolean' then value_boolean end as value_boolean,
       case when reject_code is null and value_type = 'date'
            then cast(value_timestamp as date) end as value_date
from judged_cells
""",
    typed_cells="""
select *, case column_ordinal when 1 then 'integer' when 2 then 'string' when 3 then 'number'
               when 4 then 'date' else 'boolean' end as value_type
from cells""",
    judged_cells=f"select *, {_REJECT} as reject_code from typed_cells",
)
def q_normalize_value(spark, sf):
    kind = F.element_at(
        F.array(*[F.lit(v) for v in ("integer", "string", "number", "date", "boolean")]),
        F.col("column_ordinal"),
    )
    typed = cells(spark, sf).withColumn("value_type", kind)
    return typed.select(
        *nz.ROW, "column_ordinal", "value_type",
        normalize_value(F.col("value_type")).alias("v"),
    ).select(
        *nz.ROW, "column_ordinal", "value_type", "v.reject_code",
        *[f"v.{name}" for name in TYPED_FIELDS.values()],
    )


@query(oracle=r"""
select entry_index, source_file,
       regexp_matches(source_file, '^(/|[A-Za-z]:[\\/]|[\\/]{2})')
         or list_contains(string_split(replace(source_file, '\', '/'), '/'), '..') as outside_base
from manifest_entries
""")
def q_path_guard(spark, sf):
    entries = bind(spark, sf, "manifest_entries")
    return entries.select(
        "entry_index", "source_file", escapes_base("source_file").alias("outside_base")
    )


@query(oracle=r"""
select authorization_id, root_path,
       regexp_matches(root_path, '^(/|[A-Za-z]:[\\/]|[\\/]{2})') as absolute
from output_bindings
""")
def q_absolute_path_guard(spark, sf):
    roots = bind(spark, sf, "output_bindings")
    return roots.select(
        "authorization_id", "root_path", is_absolute("root_path").alias("absolute")
    )


@query(oracle=r"""
select path, cast(nullif(regexp_extract(path, '\$\.sheets\.(\d+)', 1), '') as int) as parsed_ordinal
from (
  select case when column_ordinal = 5 then '$.workbook' else
           '$.sheets.' || sheet_ordinal || '.rows.' || row_ordinal || '.columns.' || column_ordinal
         end as path
  from cells where cell_type in ('formula', 'error', 'unknown')) p
""")
def q_finding_path(spark, sf):
    built = cell_path(F.col("sheet_ordinal"), F.col("row_ordinal"), F.col("column_ordinal"))
    flagged = cells(spark, sf).filter(F.col("cell_type").isin("formula", "error", "unknown"))
    paths = flagged.select(
        F.when(F.col("column_ordinal") == 5, "$.workbook").otherwise(built).alias("path")
    )
    return paths.select("path", sheet_ordinal_from_path(F.col("path")).alias("parsed_ordinal"))


@query(oracle="""
select finding_index, case when finding_index % 10 = 0 then '$'
       else '$.' || list_name || '.' || finding_index || '.severity' end as path
from result_findings
""")
def q_loc_to_path(spark, sf):
    found = bind(spark, sf, "result_findings")
    empty = F.array().cast("array<string>")
    loc = F.array(F.col("list_name"), F.col("finding_index").cast("string"), F.lit("severity"))
    chosen = F.when(F.col("finding_index") % 10 == 0, empty).otherwise(loc)
    return found.select("finding_index", loc_to_path(chosen).alias("path"))


@query(oracle="""
select o_orderkey as "oOrderkey", o_orderstatus as "oOrderstatus",
       o_orderpriority as "oOrderpriority", o_custkey % 7 as "nestedRowKey",
       'C-' || o_custkey as "nestedCustomerLabel"
from orders
""")
def q_alias_columns(spark, sf):
    orders = table(spark, sf, "orders")
    nested = orders.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.struct(
            (F.col("o_custkey") % 7).alias("row_key"),
            F.concat(F.lit("C-"), F.col("o_custkey")).alias("customer_label"),
        ).alias("nested_part"),
    )
    renamed = alias_columns(nested)
    return renamed.select(
        "oOrderkey", "oOrderstatus", "oOrderpriority",
        F.col("nestedPart.rowKey").alias("nestedRowKey"),
        F.col("nestedPart.customerLabel").alias("nestedCustomerLabel"),
    )


@query(oracle=r"""
select c_custkey, case c_custkey % 4 when 0 then c_name
         when 1 then regexp_replace(regexp_replace(regexp_replace(
                c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g')
         when 2 then sha256(c_name) end as shown
from customer
""")
def q_mask_by_classification(spark, sf):
    customers = table(spark, sf, "customer")
    classes = [F.lit(c) for c in ("public", "internal", "confidential", "secret")]
    kind = F.element_at(F.array(*classes), (F.col("c_custkey") % 4 + 1).cast("int"))
    return customers.select(
        "c_custkey", mask_by_classification(F.col("c_name"), kind).alias("shown")
    )


@query(oracle="""
select o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey
       || ',"o_orderstatus":' || (case when o_orderstatus = 'P' then 'null'
                                       else '"' || o_orderstatus || '"' end)
       || ',"priority":"' || o_orderpriority || '"}' as document
from orders
""")
def q_canonical_json(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("priority"), "o_orderkey", "o_custkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    return orders.select("o_orderkey", canonical_json(orders).alias("document"))


@query(oracle="""
select workbook_id, sheet_ordinal, row_ordinal, column_ordinal, cell_type, value_string,
       value_number, value_boolean, cast(value_timestamp as date) as value_day
from cells
""")
def q_melt_to_cells(spark, sf):
    return cells(spark, sf).select(
        *nz.ROW, "column_ordinal", "cell_type", "value_string", "value_number", "value_boolean",
        F.col("value_timestamp").cast("date").alias("value_day"),
    )


# --- normalization ----------------------------------------------------------------------------------

_NORMAL_STEPS = {
    "mapped_long": f"""
select *, {_REJECT} as first_reject from (
  select *, case column_ordinal when 1 then 'integer' when 2 then 'string' when 3 then 'number'
                 when 4 then 'date' else 'string' end as value_type,
         column_ordinal in (1, 2, 4) as required
  from cells where sheet_ordinal = 1 and row_ordinal >= 3) m""",
    "mapped_judged": """
select *, case when first_reject is not null then first_reject
               when required and (cell_type = 'blank'
                    or (value_type = 'string' and trim(value_string) = ''))
               then 'REQUIRED_VALUE_MISSING' end as reject
from mapped_long""",
    "data_rows": """
select workbook_id, sheet_ordinal, row_ordinal,
       cast(count(*) filter (where cell_type <> 'blank') as bigint) as mapped_cell_count,
       cast(count(*) filter (where reject is not null) as bigint) as reject_count
from mapped_judged group by workbook_id, sheet_ordinal, row_ordinal
having count(*) filter (where cell_type <> 'blank') > 0""",
    "pivoted": """
select m.workbook_id, m.sheet_ordinal, m.row_ordinal,
       max(case when column_ordinal = 1 and reject is null then cast(value_number as bigint) end) as record_key,
       max(case when column_ordinal = 2 and reject is null then nullif(trim(value_string), '') end) as record_name,
       max(case when column_ordinal = 3 and reject is null then value_number end) as amount,
       max(case when column_ordinal = 4 and reject is null then cast(value_timestamp as date) end) as order_date,
       max(case when column_ordinal = 5 and reject is null then nullif(trim(value_string), '') end) as category
from mapped_judged m join data_rows d
  on m.workbook_id = d.workbook_id and m.row_ordinal = d.row_ordinal
group by m.workbook_id, m.sheet_ordinal, m.row_ordinal""",
    "records": """
select cast(row_number() over (partition by p.workbook_id order by p.row_ordinal) - 1 as bigint)
         as record_ordinal, p.*
from pivoted p join data_rows d on p.workbook_id = d.workbook_id and p.row_ordinal = d.row_ordinal
where d.reject_count = 0""",
}


@query(
    oracle="select workbook_id, sheet_ordinal, row_ordinal, mapped_cell_count from data_rows",
    **_NORMAL_STEPS,
)
def q_drop_blank_rows(spark, sf):
    return nz.drop_blank_rows(grid(spark, sf), SHEET_SPEC)


_FIELDS = [c.field for c in SHEET_SPEC.columns]


@query(oracle="select * from pivoted", **_NORMAL_STEPS)
def q_map_columns(spark, sf):
    return nz.map_columns(grid(spark, sf), SHEET_SPEC).select(*nz.ROW, *_FIELDS)


@query(
    oracle="""
select m.workbook_id as subject_id, 'WARNING' as severity, reject as code,
       '$.sheets.1.rows.' || m.row_ordinal || '.columns.' || column_ordinal as path
from mapped_judged m join data_rows d
  on m.workbook_id = d.workbook_id and m.row_ordinal = d.row_ordinal
where reject is not null
""",
    **_NORMAL_STEPS,
)
def q_reject_rows(spark, sf):
    return nz.reject_rows(nz.map_columns(grid(spark, sf), SHEET_SPEC), SHEET_SPEC)


@query(
    oracle="select record_ordinal, workbook_id, sheet_ordinal, row_ordinal from records",
    **_NORMAL_STEPS,
)
def q_record_ordinal(spark, sf):
    return nz.record_ordinal(grid(spark, sf), SHEET_SPEC).select("record_ordinal", *nz.ROW)


@query(
    oracle="""
select workbook_id, record_ordinal, 'TEST-DATASET-001' as dataset_id,
       'SRC-' || workbook_id as source_id, sheet_ordinal as source_sheet_ordinal,
       row_ordinal as source_row_ordinal, record_key, record_name, amount, order_date, category
from records
""",
    **_NORMAL_STEPS,
)
def q_normalized_records(spark, sf):
    sources = bind(spark, sf, "workbooks").select(
        "workbook_id", F.concat(F.lit("SRC-"), F.col("workbook_id")).alias("source_id")
    )
    records = nz.normalized_records(grid(spark, sf), SHEET_SPEC, sources)
    return records.select(*[c for c in records.columns if c != "values"], "values.*")


@query(
    oracle="""
select d.workbook_id, 'TEST-DATASET-001' as dataset_id, d.sheet_ordinal as source_sheet_ordinal,
       column_ordinal as source_column_ordinal,
       case column_ordinal when 1 then 'record_key' when 2 then 'record_name' when 3 then 'amount'
            when 4 then 'order_date' else 'category' end as target_field,
       max(value_type) as value_type, bool_or(required) as required,
       cast(count(*) filter (where d.reject_count = 0 and cell_type <> 'blank'
            and (value_type <> 'string' or trim(value_string) <> '')) as bigint) as mapped_record_count,
       cast(count(*) filter (where reject is not null) as bigint) as rejected_record_count
from mapped_judged m join data_rows d
  on m.workbook_id = d.workbook_id and m.row_ordinal = d.row_ordinal
group by d.workbook_id, d.sheet_ordinal, column_ordinal
""",
    **_NORMAL_STEPS,
)
def q_mapping_evidence(spark, sf):
    return nz.mapping_evidence(nz.map_columns(grid(spark, sf), SHEET_SPEC), SHEET_SPEC)


@query(
    oracle="""
select workbook_id, sheet_ordinal, 'TEST-DATASET-001' as dataset_id,
       count(*) as source_record_count,
       cast(count(*) filter (where reject_count = 0) as bigint) as normalized_record_count,
       cast(count(*) filter (where reject_count > 0) as bigint) as rejected_record_count,
       cast(sum(reject_count) as bigint) as finding_count,
       sum(reject_count) > 0 as human_review_required
from data_rows group by workbook_id, sheet_ordinal
""",
    **_NORMAL_STEPS,
)
def q_normalization_summary(spark, sf):
    return nz.normalization_summary(nz.map_columns(grid(spark, sf), SHEET_SPEC), SHEET_SPEC)


# --- profiling --------------------------------------------------------------------------------------

_KIND_COUNTS = ",\n".join(
    f"cast(count(*) filter (where cell_type = '{c}') as bigint) as {c}_count"
    for c in CELL_CATEGORIES
)
_NON_EMPTY = "cast(count(*) filter (where cell_type <> 'blank') as bigint) as non_empty_cell_count"


@query(oracle=f"""
select workbook_id, sheet_ordinal, {_KIND_COUNTS}, {_NON_EMPTY}
from cells group by workbook_id, sheet_ordinal
""")
def q_cell_type_counts(spark, sf):
    return pf.cell_type_counts(pf.scanned(grid(spark, sf), OPTIONS))


def _blank_oracle(axis: str, name: str) -> str:
    return f"""
select workbook_id, sheet_ordinal, cast(count(*) as bigint) as scanned_{name}_count,
       cast(count(*) filter (where not filled) as bigint) as blank_{name}_count
from (select workbook_id, sheet_ordinal, {axis}, bool_or(cell_type <> 'blank') as filled
      from cells group by workbook_id, sheet_ordinal, {axis}) x
group by workbook_id, sheet_ordinal
"""


@query(oracle=_blank_oracle("row_ordinal", "row"))
def q_blank_row_count(spark, sf):
    return pf.blank_row_count(pf.scanned(grid(spark, sf), OPTIONS))


@query(oracle=_blank_oracle("column_ordinal", "column"))
def q_blank_column_count(spark, sf):
    return pf.blank_column_count(pf.scanned(grid(spark, sf), OPTIONS))


def _profile_steps(rows: int | None = None, columns: int | None = None) -> dict[str, str]:
    scan, truncated, excessive = "true", "false", "false"
    if rows is not None:
        scan = f"row_ordinal <= {rows} and column_ordinal <= {columns}"
        truncated = f"(declared_rows > {rows} or declared_columns > {columns})"
        excessive = f"(declared_rows > {10 * rows} or declared_columns > {10 * columns})"
    return {
        "budget_findings": f"""
select workbook_id as subject_id, 'WARNING' as severity, 'WORKBOOK_SCAN_LIMIT_REACHED' as code,
       '$.sheets.' || sheet_ordinal as path from sheet_structure where {truncated}
union all
select workbook_id, 'WARNING', 'WORKBOOK_DECLARED_DIMENSION_EXCESSIVE',
       '$.sheets.' || sheet_ordinal from sheet_structure where {excessive}""",
        "sheet_counts": f"""
select workbook_id, sheet_ordinal, {_KIND_COUNTS}, {_NON_EMPTY}
from cells where {scan} group by workbook_id, sheet_ordinal""",
        "verdicts": f"""
select s.*, case when not {truncated} and coalesce(c.non_empty_cell_count, 0) = 0
              and merged_range_count + hyperlink_count + data_validation_count + table_count
                  + comment_count = 0
            then case when drawing_count = 0 then 'WORKBOOK_EMPTY_SHEET'
                      else 'WORKBOOK_DRAWING_ONLY_SHEET' end end as verdict
from sheet_structure s left join sheet_counts c
  on s.workbook_id = c.workbook_id and s.sheet_ordinal = c.sheet_ordinal""",
        "top_rows": f"""
select workbook_id, sheet_ordinal, row_ordinal,
       count(*) filter (where cell_type <> 'blank') as filled,
       count(*) filter (where cell_type in ('string', 'inline_string')) as texts,
       count(distinct case when cell_type in ('string', 'inline_string')
                           then {_collapsed('value_string')} end) as digests
from cells where {scan} and row_ordinal <= 10
group by workbook_id, sheet_ordinal, row_ordinal""",
        "header_rows": """
select workbook_id, sheet_ordinal, min(row_ordinal) as header_row
from top_rows where filled >= 2 and texts * 2 >= filled group by workbook_id, sheet_ordinal""",
        "scan_ends": f"""
select workbook_id, sheet_ordinal, max(row_ordinal) as last_row
from cells where {scan} group by workbook_id, sheet_ordinal""",
        "headers": """
select s.workbook_id, s.sheet_ordinal, h.header_row as inferred_header_row,
       case when h.header_row is null then 'none'
            when t.texts * 5 >= t.filled * 4 and h.header_row < e.last_row
                 and s.merged_top_rows = 0 then 'high'
            else 'medium' end as header_confidence,
       cast(coalesce(t.texts - t.digests, 0) as bigint) as duplicate_header_digests,
       s.merged_top_rows
from sheet_structure s
left join header_rows h on s.workbook_id = h.workbook_id and s.sheet_ordinal = h.sheet_ordinal
left join top_rows t on h.workbook_id = t.workbook_id and h.sheet_ordinal = t.sheet_ordinal
                    and h.header_row = t.row_ordinal
left join scan_ends e on s.workbook_id = e.workbook_id and s.sheet_ordinal = e.sheet_ordinal""",
        "all_sheet_findings": """
select workbook_id as subject_id, 'WARNING' as severity, verdict as code,
       '$.sheets.' || sheet_ordinal as path from verdicts where verdict is not null
union all
select h.workbook_id, 'WARNING',
       unnest(list_filter([
         case when inferred_header_row is not null and h.merged_top_rows > 0
              then 'WORKBOOK_MERGED_HEADER_REGION' end,
         case when inferred_header_row is not null and duplicate_header_digests > 0
              then 'WORKBOOK_DUPLICATE_HEADER_DIGEST' end], lambda x : x is not null)),
       '$.sheets.' || h.sheet_ordinal || '.rows.' || inferred_header_row
from headers h
union all
select h.workbook_id, 'WARNING', 'WORKBOOK_HEADER_NOT_DETECTED', '$.sheets.' || h.sheet_ordinal
from headers h join verdicts v on h.workbook_id = v.workbook_id and h.sheet_ordinal = v.sheet_ordinal
where inferred_header_row is null and verdict is null
union all select * from budget_findings
union all
select workbook_id, 'WARNING', 'WORKBOOK_CELL_ERROR_PRESENT', '$.sheets.' || sheet_ordinal
from sheet_counts where error_count > 0""",
        "rollup": """
select w.workbook_id, w.skipped_part_count, w.has_workbook_protection,
       count(*) as sheet_count,
       cast(count(*) filter (where state not in ('hidden', 'veryHidden')) as bigint) as visible_sheet_count,
       cast(count(*) filter (where state = 'hidden') as bigint) as hidden_sheet_count,
       cast(count(*) filter (where state = 'veryHidden') as bigint) as very_hidden_sheet_count,
       cast(sum(merged_range_count) as bigint) as merged_range_count,
       cast(sum(hidden_row_count) as bigint) as hidden_row_count,
       cast(sum(hidden_column_count) as bigint) as hidden_column_count,
       cast(sum(hyperlink_count) as bigint) as hyperlink_count,
       cast(sum(data_validation_count) as bigint) as data_validation_count,
       cast(sum(table_count) as bigint) as table_count,
       cast(sum(coalesce(formula_count, 0)) as bigint) as formula_cell_count,
       cast(count(*) filter (where coalesce(error_count, 0) > 0) as bigint) as error_sheet_count,
       bool_or(has_sheet_protection) as has_sheet_protection
from workbooks w join sheet_structure s on w.workbook_id = s.workbook_id
left join sheet_counts c on s.workbook_id = c.workbook_id and s.sheet_ordinal = c.sheet_ordinal
group by w.workbook_id, w.skipped_part_count, w.has_workbook_protection""",
        "all_findings": """
select * from all_sheet_findings
union all
select workbook_id, 'WARNING', unnest(list_filter([
   case when skipped_part_count > 0 then 'WORKBOOK_XML_PART_SCAN_SKIPPED' end,
   case when hidden_sheet_count > 0 then 'WORKBOOK_HIDDEN_SHEET_PRESENT' end,
   case when very_hidden_sheet_count > 0 then 'WORKBOOK_VERY_HIDDEN_SHEET_PRESENT' end,
   case when formula_cell_count > 0 then 'WORKBOOK_FORMULA_PRESENT' end,
   case when has_sheet_protection or has_workbook_protection then 'WORKBOOK_PROTECTION_ENABLED' end
 ], lambda x : x is not null)), '$.workbook'
from rollup""",
        "summary": """
select w.workbook_id, w.provenance_verified, count(f.code) as finding_count,
       cast(count(*) filter (where f.severity = 'ERROR') as bigint) as error_count,
       w.provenance_verified and count(f.code) = 0 as normalization_ready,
       not w.provenance_verified or count(f.code) > 0 as human_review_required
from workbooks w left join all_findings f on w.workbook_id = f.subject_id
group by w.workbook_id, w.provenance_verified""",
    }


_PROFILE_STEPS = _profile_steps()
_TIGHT_STEPS = _profile_steps(SCAN_ROWS, SCAN_COLUMNS)


@query(oracle="select * from budget_findings", **_TIGHT_STEPS)
def q_scan_budget(spark, sf):
    return pf.scan_budget(bind(spark, sf, "sheet_structure"), TIGHT)


@query(
    oracle="""
select workbook_id, sheet_ordinal, verdict as code, '$.sheets.' || sheet_ordinal as path
from verdicts where verdict is not null
""",
    **_TIGHT_STEPS,
)
def q_empty_sheet_verdict(spark, sf):
    structure = bind(spark, sf, "sheet_structure")
    return pf.empty_sheet_verdict(grid(spark, sf), structure, TIGHT)


def _headers(spark, sf):
    return pf.infer_header(
        pf.scanned(grid(spark, sf), OPTIONS), bind(spark, sf, "sheet_structure")
    )


@query(oracle="select * from headers", **_PROFILE_STEPS)
def q_infer_header(spark, sf):
    return _headers(spark, sf)


@query(
    oracle=f"""
select c.workbook_id, c.sheet_ordinal, c.row_ordinal, c.column_ordinal,
       sha256({_collapsed('c.value_string')}) as value_digest,
       cast(length({_collapsed('c.value_string')}) as int) as normalized_length, c.cell_type
from cells c join header_rows h on c.workbook_id = h.workbook_id
  and c.sheet_ordinal = h.sheet_ordinal and c.row_ordinal = h.header_row
where c.cell_type in ('string', 'inline_string')
""",
    **_PROFILE_STEPS,
)
def q_header_candidates(spark, sf):
    return pf.header_candidates(pf.scanned(grid(spark, sf), OPTIONS), _headers(spark, sf))


@query(
    oracle="""
select workbook_id, sheet_ordinal, inferred_header_row, duplicate_header_digests
from headers where duplicate_header_digests > 0
""",
    **_PROFILE_STEPS,
)
def q_duplicate_header_digests(spark, sf):
    return pf.duplicate_header_digests(_headers(spark, sf))


def _profile(spark, sf):
    return pf.sheet_profile(grid(spark, sf), bind(spark, sf, "sheet_structure"), OPTIONS)


def _inspected(spark, sf, **options) -> pf.Inspection:
    return pf.inspect(
        grid(spark, sf), bind(spark, sf, "sheet_structure"), bind(spark, sf, "workbooks"), pf.InspectionOptions(**options)
    )


def profile_findings(spark, sf):
    return _inspected(spark, sf).findings


@query(
    oracle=f"""
select v.workbook_id, v.sheet_ordinal, sha256(sheet_name) as sheet_name_digest, state,
       declared_rows, declared_columns, {', '.join(pf.STRUCTURE_COUNTS)}, has_sheet_protection,
       v.merged_top_rows,
       {', '.join(f'cast(coalesce({c}_count, 0) as bigint) as {c}_count' for c in CELL_CATEGORIES)},
       cast(coalesce(non_empty_cell_count, 0) as bigint) as non_empty_cell_count,
       cast(coalesce(r.n, 0) as bigint) as scanned_row_count,
       cast(coalesce(r.blank, 0) as bigint) as blank_row_count,
       cast(coalesce(k.blank, 0) as bigint) as blank_column_count, verdict,
       case when verdict is null then inferred_header_row end as inferred_header_row,
       case when verdict is null then header_confidence else 'none' end as header_confidence,
       case when verdict is null then duplicate_header_digests else 0 end as duplicate_header_digests
from verdicts v
join headers h on v.workbook_id = h.workbook_id and v.sheet_ordinal = h.sheet_ordinal
left join sheet_counts c on v.workbook_id = c.workbook_id and v.sheet_ordinal = c.sheet_ordinal
left join (select workbook_id, sheet_ordinal, count(*) as n, count(*) filter (where not filled) as blank
           from (select workbook_id, sheet_ordinal, row_ordinal, bool_or(cell_type <> 'blank') as filled
                 from cells group by all) x group by all) r
  on v.workbook_id = r.workbook_id and v.sheet_ordinal = r.sheet_ordinal
left join (select workbook_id, sheet_ordinal, count(*) filter (where not filled) as blank
           from (select workbook_id, sheet_ordinal, column_ordinal, bool_or(cell_type <> 'blank') as filled
                 from cells group by all) x group by all) k
  on v.workbook_id = k.workbook_id and v.sheet_ordinal = k.sheet_ordinal
""",
    **_PROFILE_STEPS,
)
def q_sheet_profile(spark, sf):
    return _profile(spark, sf)


@query(oracle="select * from rollup", **_PROFILE_STEPS)
def q_workbook_rollup(spark, sf):
    return _inspected(spark, sf).rollup


@query(
    oracle="select code, count(*) as finding_count from all_findings group by code",
    **_PROFILE_STEPS,
)
def q_finding_counts(spark, sf):
    return pf.finding_counts(profile_findings(spark, sf))


@query(oracle="select * from summary", **_PROFILE_STEPS)
def q_inspection_summary(spark, sf):
    return _inspected(spark, sf).summary


@query(
    oracle="""
select s.workbook_id, r.workbook_id is not null as inspection_completed,
       coalesce(r.workbook_id is not null and error_count = 0 and r.formula_cell_count <= 0
                and r.skipped_part_count <= 0, false) as accepted
from summary s left join rollup r on s.workbook_id = r.workbook_id
""",
    **_PROFILE_STEPS,
)
def q_inspection_gate(spark, sf):
    return _inspected(spark, sf, fail_on_formulas=True, fail_on_unsupported_feature=True).gate


# --- containers -------------------------------------------------------------------------------------

_CONTAINER_STEPS = {
    "containers": r"""
select workbook_id, count(*) as entry_count,
       cast(sum(compress_size) as bigint) as total_compressed_size,
       cast(sum(file_size) as bigint) as total_uncompressed_size,
       max(file_size) as max_entry_uncompressed_size,
       round_even(sum(file_size) / greatest(sum(compress_size), 1), 4) as compression_ratio,
       cast(count(*) filter (where flag_bits & 1 = 1) as bigint) as encrypted_entry_count,
       bool_or(entry_name like '%vbaProject.bin'
               or (entry_name = '[Content_Types].xml' and contains(coalesce(text, ''), 'macroEnabled'))
               or (entry_name = 'xl/_rels/workbook.xml.rels' and contains(coalesce(text, ''), 'vbaProject')))
         as macro_detected,
       cast(count(*) filter (where starts_with(entry_name, 'xl/externalLinks/')) as bigint) as external_link_part_count,
       cast(sum(case when entry_name = 'xl/_rels/workbook.xml.rels'
                     then len(regexp_extract_all(coalesce(text, ''), 'Type="[^"]*/externalLink"')) else 0 end) as bigint)
         as external_link_relationship_count,
       cast(count(*) filter (where starts_with(entry_name, 'xl/embeddings/'))
            + count(*) filter (where contains(entry_name, 'oleObject')) as bigint) as embedded_object_part_count,
       cast(count(*) filter (where starts_with(entry_name, 'xl/activeX/')) as bigint) as activex_part_count,
       cast(count(*) filter (where starts_with(entry_name, 'customXml/')) as bigint) as custom_xml_part_count,
       cast(count(*) filter (where starts_with(entry_name, '_xmlsignatures/')) as bigint) as digital_signature_part_count,
       cast(count(*) filter (where starts_with(entry_name, 'xl/drawings/') and not contains(entry_name, '_rels')) as bigint)
         as drawing_part_count,
       cast(count(*) filter (where regexp_full_match(entry_name, 'xl/comments(/comment)?\d*\.xml')) as bigint)
         as comment_part_count,
       bool_or(entry_name = '[Content_Types].xml') and bool_or(entry_name = 'xl/workbook.xml')
         as required_parts_present,
       bool_or(starts_with(entry_name, '/') or regexp_matches(entry_name, '^[A-Za-z]:')
               or list_contains(string_split(replace(entry_name, '\', '/'), '/'), '..')) as traversal_entry,
       count(*) > count(distinct entry_name) as duplicate_entry
from parts group by workbook_id""",
}


@query(
    oracle="""
select * exclude (duplicate_entry),
       external_link_part_count + external_link_relationship_count > 0 as external_link_detected
from containers
""",
    **_CONTAINER_STEPS,
)
def q_container_profile(spark, sf):
    return pf.container_profile(bind(spark, sf, "parts"))


@query(
    oracle="""
select workbook_id as subject_id, severity, code, '$.zipContainer' as path, severity = 'ERROR' as fatal
from (
  select workbook_id, unnest([
    case when not required_parts_present then 'ERROR:XLSX_REQUIRED_PART_MISSING' end,
    case when traversal_entry then 'ERROR:XLSX_PATH_TRAVERSAL_ENTRY' end,
    case when duplicate_entry then 'ERROR:XLSX_DUPLICATE_ENTRY' end,
    case when encrypted_entry_count > 0 then 'ERROR:XLSX_ENCRYPTED_ENTRY' end,
    case when macro_detected then 'ERROR:WORKBOOK_MACRO_DETECTED' end,
    case when external_link_part_count + external_link_relationship_count > 0
         then 'WARNING:WORKBOOK_EXTERNAL_LINK_DETECTED' end,
    case when embedded_object_part_count > 0 then 'ERROR:WORKBOOK_EMBEDDED_OBJECT_DETECTED' end,
    case when activex_part_count > 0 then 'ERROR:WORKBOOK_ACTIVEX_DETECTED' end,
    case when custom_xml_part_count > 0 then 'WARNING:WORKBOOK_CUSTOM_XML_PRESENT' end,
    case when digital_signature_part_count > 0 then 'WARNING:WORKBOOK_DIGITAL_SIGNATURE_PRESENT' end
  ]) as tagged from containers) t,
  lateral (select split_part(tagged, ':', 1) as severity, split_part(tagged, ':', 2) as code) s
where tagged is not null
""",
    **_CONTAINER_STEPS,
)
def q_container_findings(spark, sf):
    lenient = pf.InspectionOptions(fail_on_external_links=False)
    return pf.container_findings(bind(spark, sf, "parts"), lenient)
