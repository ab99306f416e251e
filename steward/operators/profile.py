"""Workbook profiling: counts over the cell grid, header inference, container checks, roll-ups.

Operators take a grid in either shape (`sources.grid`); in row shape, facts about single rows need no
shuffle. What leaves the first aggregation is one row per (sheet, column) or per sheet, combined on the map side.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from steward.functions.paths import is_traversal_entry, row_path, sheet_path
from steward.functions.text import digest_text, name_digest, normalized_length
from steward.schemas import CELL_CATEGORIES, ERROR, HEADER_SCAN_DEPTH, WARNING
from steward.sources.grid import VALUES, cells_of, kind_of, raw_cells, rows_of
from steward.staging import staged

SHEET = ["workbook_id", "sheet_ordinal"]
STRUCTURE_COUNTS = (
    "merged_range_count", "hidden_row_count", "hidden_column_count", "comment_count",
    "hyperlink_count", "data_validation_count", "table_count", "drawing_count",
)


@dataclass(frozen=True)
class InspectionOptions:
    """A limit of None reads whole sheets."""

    max_rows_per_sheet: int | None = None
    max_columns_per_sheet: int | None = None
    allow_pending_manifest: bool = False
    fail_on_formulas: bool = False
    fail_on_external_links: bool = True
    fail_on_macros: bool = True
    fail_on_embedded_objects: bool = True
    fail_on_unsupported_feature: bool = False

    def __post_init__(self):
        if any(x is not None and x <= 0 for x in (self.max_rows_per_sheet, self.max_columns_per_sheet)):
            raise ValueError("INVALID_INSPECTION_OPTION: scan limits must be positive")


def finding(code: str, path: Column, severity: str | Column = WARNING) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(severity.alias("severity"), F.lit(code).alias("code"), path.alias("path"))


def findings_of(df: DataFrame, subject: str, rules: list[tuple[Column, Column]]) -> DataFrame:
    """One finding row per rule that holds: an array per row, exploded in the same stage."""
    found = F.array_compact(F.array(*[F.when(condition, body) for condition, body in rules]))
    return df.select(F.col(subject).alias("subject_id"), F.explode(found).alias("f")).select(
        "subject_id", "f.*"
    )


# --- cell counts --------------------------------------------------------------------------------


def scanned(grid: DataFrame, options: InspectionOptions) -> DataFrame:
    """The part of the grid inside the scan budget, in the same shape."""
    rows, columns = options.max_rows_per_sheet, options.max_columns_per_sheet
    if rows is not None:
        grid = grid.filter(F.col("row_ordinal") <= rows)
    if columns is None:
        return grid
    if "cells" in grid.columns:
        kept = F.when(F.size("cells") > columns, F.slice("cells", 1, columns)).otherwise(F.col("cells"))
        return grid.withColumn("cells", kept)
    return grid.filter(F.col("column_ordinal") <= columns)


def _cells(grid: DataFrame) -> DataFrame:
    return cells_of(grid) if "cells" in grid.columns else grid


def cell_type_counts(grid: DataFrame) -> DataFrame:
    """Counts per category, plus non-empty, formula and error totals, per sheet."""
    cells = _cells(grid)
    kind = F.col("cell_type")
    per_kind = [F.count_if(kind == c).alias(f"{c}_count") for c in CELL_CATEGORIES]
    return cells.groupBy(*SHEET).agg(
        *per_kind, F.count_if(kind != "blank").alias("non_empty_cell_count")
    )


def _row_filled(rows: DataFrame) -> Column:
    """Whether a grid row has a cell with a value; it mostly shows at the first."""
    if raw_cells(rows):
        return F.exists("cells", lambda c: reduce(or_, (c[v].isNotNull() for v in VALUES)))
    return F.exists("cells", lambda c: c["cell_type"] != "blank")


def blank_row_count(grid: DataFrame) -> DataFrame:
    """Rows of the scan without any non-blank cell, per sheet."""
    rows = rows_of(grid).filter(F.size("cells") > 0)
    return rows.select(*SHEET, _row_filled(rows).alias("filled")).groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("scanned_row_count"),
        F.count_if(~F.col("filled")).alias("blank_row_count"),
    )


def blank_column_count(grid: DataFrame) -> DataFrame:
    """Columns of the scan without any non-blank cell, per sheet."""
    columns = _cells(grid).groupBy(*SHEET, "column_ordinal").agg(
        F.bool_or(F.col("cell_type") != "blank").alias("filled")
    )
    return columns.groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("scanned_column_count"),
        F.count_if(~F.col("filled")).alias("blank_column_count"),
    )


def _beyond(options: InspectionOptions, times: int) -> Column:
    limits = (("declared_rows", options.max_rows_per_sheet), ("declared_columns", options.max_columns_per_sheet))
    over = F.lit(False)
    for declared, limit in limits:
        if limit is not None:
            over = over | (F.col(declared) > times * limit)
    return over


def _truncated(options: InspectionOptions) -> Column:
    return _beyond(options, 1)


def _excessive(options: InspectionOptions) -> Column:
    return _beyond(options, 10)


def _budget_rules(options: InspectionOptions) -> list[tuple[Column, Column]]:
    path = sheet_path(F.col("sheet_ordinal"))
    return [
        (_truncated(options), finding("WORKBOOK_SCAN_LIMIT_REACHED", path)),
        (_excessive(options), finding("WORKBOOK_DECLARED_DIMENSION_EXCESSIVE", path)),
    ]


def scan_budget(structure: DataFrame, options: InspectionOptions) -> DataFrame:
    """Findings about *declared* dimensions beyond the scan budget."""
    return findings_of(structure, "workbook_id", _budget_rules(options))


# --- empty sheets and headers --------------------------------------------------------------------


def _record_free(options: InspectionOptions) -> Column:
    unused = [
        F.col(c) == 0
        for c in ("merged_range_count", "hyperlink_count", "data_validation_count",
                  "table_count", "comment_count")
    ]
    free = ~_truncated(options) & (F.coalesce(F.col("non_empty_cell_count"), F.lit(0)) == 0)
    for condition in unused:
        free = free & condition
    return free


def _verdict(options: InspectionOptions) -> Column:
    return F.when(
        _record_free(options),
        F.when(F.col("drawing_count") == 0, "WORKBOOK_EMPTY_SHEET").otherwise(
            "WORKBOOK_DRAWING_ONLY_SHEET"
        ),
    )


def empty_sheet_verdict(
    grid: DataFrame, structure: DataFrame, options: InspectionOptions
) -> DataFrame:
    """Sheets proven empty or drawing-only; needs the whole sheet inside the budget."""
    filled = _cells(scanned(grid, options)).groupBy(*SHEET).agg(
        F.count_if(F.col("cell_type") != "blank").alias("non_empty_cell_count")
    )
    judged = structure.join(filled, SHEET, "left").withColumn("verdict", _verdict(options))
    return judged.filter(F.col("verdict").isNotNull()).select(
        *SHEET, F.col("verdict").alias("code"), sheet_path(F.col("sheet_ordinal")).alias("path")
    )


#: Facts of a top row in one long, so that they combine without sorting: row, filled cells, texts, repeated texts.
_COUNT_BITS = 19


def _header_code(rows: DataFrame) -> Column:
    """Of a grid row that may be a header, its facts as one number; the smallest is the uppermost row's."""
    kind = f"({kind_of(rows, 'c.')})"
    texts = f"filter(cells, c -> {kind} IN ('string', 'inline_string'))"
    filled = f"size(filter(cells, c -> {kind} <> 'blank'))"
    distinct = F.size(F.array_distinct(F.transform(F.expr(texts), lambda c: digest_text(c["value_string"]))))
    facts = F.struct(F.expr(filled).alias("filled"), F.expr(f"size({texts})").alias("texts"), distinct.alias("digests"))
    # One pass over the cells of a top row, none over those of other rows.
    judged = F.transform(F.array(facts), lambda f: F.when(
        (f["filled"] >= 2) & (2 * f["texts"] >= f["filled"]),
        ((F.col("row_ordinal") * (1 << _COUNT_BITS) + f["filled"]) * (1 << _COUNT_BITS) + f["texts"]) * (1 << _COUNT_BITS) + f["texts"] - f["digests"]))
    return F.when(F.col("row_ordinal") <= HEADER_SCAN_DEPTH, F.get(judged, F.lit(0)))


def _header_fields(code: str, last_row: str) -> list[Column]:
    """Header row, confidence and repeated digests from the facts of the uppermost row that qualifies."""
    part = lambda i: F.expr(f"shiftright({code}, {i * _COUNT_BITS}) % {1 << _COUNT_BITS}")
    row, filled, texts, repeats = F.expr(f"shiftright({code}, {3 * _COUNT_BITS})"), part(2), part(1), part(0)
    sure = (5 * texts >= 4 * filled) & (row < F.col(last_row)) & (F.col("merged_top_rows") == 0)
    return [
        row.alias("inferred_header_row"),
        F.when(F.col(code).isNull(), "none").when(sure, "high").otherwise("medium").alias("header_confidence"),
        F.coalesce(repeats, F.lit(0)).cast("bigint").alias("duplicate_header_digests"),
    ]


def infer_header(grid: DataFrame, structure: DataFrame) -> DataFrame:
    """Header row, confidence and repeated header digests of every sheet in `structure`.

    The first of the top rows with at least two filled cells, half of them text, is the header.
    One row past the search depth is read too, only to see whether the scan goes on below it.
    """
    top = rows_of(grid.filter(F.col("row_ordinal") <= HEADER_SCAN_DEPTH + 1))
    per_sheet = top.select(*SHEET, "row_ordinal", _header_code(top).alias("code")).groupBy(*SHEET).agg(
        F.min("code").alias("_code"), F.max("row_ordinal").alias("_last"))
    joined = structure.select(*SHEET, "merged_top_rows").join(per_sheet, SHEET, "left")
    return joined.select(*SHEET, *_header_fields("_code", "_last"), "merged_top_rows")


def header_findings(headers: DataFrame) -> DataFrame:
    sheet, row = F.col("sheet_ordinal"), F.col("inferred_header_row")
    at_row = row_path(sheet, row)
    return findings_of(headers, "workbook_id", _header_rules(at_row))


def _header_rules(at_row: Column) -> list[tuple[Column, Column]]:
    found = F.col("inferred_header_row").isNotNull()
    return [
        (found & (F.col("merged_top_rows") > 0), finding("WORKBOOK_MERGED_HEADER_REGION", at_row)),
        (
            found & (F.col("duplicate_header_digests") > 0),
            finding("WORKBOOK_DUPLICATE_HEADER_DIGEST", at_row),
        ),
        (~found, finding("WORKBOOK_HEADER_NOT_DETECTED", sheet_path(F.col("sheet_ordinal")))),
    ]


def header_candidates(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Text cells of the header row as digests and lengths, never as text."""
    top = _cells(grid.filter(F.col("row_ordinal") <= HEADER_SCAN_DEPTH)).filter(
        F.col("cell_type").isin("string", "inline_string")
    )
    rows = headers.filter(F.col("inferred_header_row").isNotNull()).select(
        *SHEET, F.col("inferred_header_row").alias("row_ordinal")
    )
    return top.join(rows, [*SHEET, "row_ordinal"], "left_semi").select(
        *SHEET, "row_ordinal", "column_ordinal",
        digest_text(F.col("value_string")).alias("value_digest"),
        normalized_length(F.col("value_string")).alias("normalized_length"),
        "cell_type",
    )


def duplicate_header_digests(headers: DataFrame) -> DataFrame:
    return headers.filter(F.col("duplicate_header_digests") > 0).select(
        *SHEET, "inferred_header_row", "duplicate_header_digests"
    )


# --- whole sheets and workbooks -------------------------------------------------------------------


def sheet_profile(
    grid: DataFrame, structure: DataFrame, options: InspectionOptions
) -> DataFrame:
    """One row per sheet with every count, the verdict and the header, from one pass over the grid.

    What concerns a row as a whole (that it exists, that it is filled, its facts as a header) rides on its
    first cell, so that one aggregation by (sheet, column) counts cells, columns and rows together.
    """
    rows = rows_of(scanned(grid, options))
    budget = rows.select(
        *SHEET, "row_ordinal", "cells", _row_filled(rows).alias("filled"), _header_code(rows).alias("code"))
    cells = budget.select(
        *SHEET, "row_ordinal", "filled", "code", F.posexplode("cells").alias("position", "cell"))
    cells = cells.withColumn("kind", F.expr(kind_of(rows, "cell.")))
    kind = F.col("kind")
    first = F.col("position") == 0
    columns = cells.groupBy(*SHEET, "position").agg(
        *[F.count_if(kind == c).alias(f"{c}_count") for c in CELL_CATEGORIES],
        F.count_if(first).alias("rows"), F.count_if(first & ~F.col("filled")).alias("blank"),
        F.min(F.when(first, F.col("code"))).alias("code"),
        F.max(F.when(first, F.least("row_ordinal", F.lit(HEADER_SCAN_DEPTH + 1)))).alias("last"),
    )
    used = sum((F.col(f"{c}_count") for c in CELL_CATEGORIES[1:]), start=F.lit(0))
    totals = columns.groupBy(*SHEET).agg(
        *[F.sum(f"{c}_count").alias(f"{c}_count") for c in CELL_CATEGORIES],
        F.sum(used).alias("non_empty_cell_count"),
        F.count_if(used == 0).alias("blank_column_count"),
        F.sum("rows").alias("scanned_row_count"), F.sum("blank").alias("blank_row_count"),
        F.min("code").alias("_code"), F.max("last").alias("_last"),
    )
    joined = (
        structure.join(totals, SHEET, "left")
        .select("*", *_header_fields("_code", "_last"))
        .withColumn("verdict", _verdict(options))
    )
    counted = [
        F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
        for c in (*[f"{k}_count" for k in CELL_CATEGORIES], "non_empty_cell_count",
                  "scanned_row_count", "blank_row_count", "blank_column_count")
    ]
    judged = F.col("verdict").isNull()
    return joined.select(
        *SHEET,
        name_digest(F.col("sheet_name")).alias("sheet_name_digest"),
        "state", "declared_rows", "declared_columns", *STRUCTURE_COUNTS,
        "has_sheet_protection", "merged_top_rows", *counted, "verdict",
        F.when(judged, F.col("inferred_header_row")).alias("inferred_header_row"),
        F.when(judged, F.col("header_confidence")).otherwise("none").alias("header_confidence"),
        F.when(judged, F.col("duplicate_header_digests")).otherwise(0).cast("bigint").alias(
            "duplicate_header_digests"
        ),
    )


def sheet_findings(profile: DataFrame, options: InspectionOptions) -> DataFrame:
    """All findings about single sheets, in the order they are raised."""
    path = sheet_path(F.col("sheet_ordinal"))
    at_row = row_path(F.col("sheet_ordinal"), F.col("inferred_header_row"))
    verdict = F.col("verdict")
    rules = [
        (verdict == code, finding(code, path))
        for code in ("WORKBOOK_EMPTY_SHEET", "WORKBOOK_DRAWING_ONLY_SHEET")
    ]
    rules += [(verdict.isNull() & when, body) for when, body in _header_rules(at_row)]
    rules += _budget_rules(options)
    rules.append((F.col("error_count") > 0, finding("WORKBOOK_CELL_ERROR_PRESENT", path)))
    return findings_of(profile, "workbook_id", rules)


def workbook_rollup(profile: DataFrame, workbooks: DataFrame) -> DataFrame:
    """Per workbook: sheet states, structural sums, formula total and protection."""
    state = F.col("state")
    sums = ("merged_range_count", "hidden_row_count", "hidden_column_count", "hyperlink_count",
            "data_validation_count", "table_count")
    totals = profile.groupBy("workbook_id").agg(
        F.count(F.lit(1)).alias("sheet_count"),
        F.count_if(~state.isin("hidden", "veryHidden")).alias("visible_sheet_count"),
        F.count_if(state == "hidden").alias("hidden_sheet_count"),
        F.count_if(state == "veryHidden").alias("very_hidden_sheet_count"),
        *[F.sum(c).cast("bigint").alias(c) for c in sums],
        F.sum("formula_count").cast("bigint").alias("formula_cell_count"),
        F.count_if(F.col("error_count") > 0).alias("error_sheet_count"),
        F.bool_or("has_sheet_protection").alias("has_sheet_protection"),
    )
    return workbooks.select("workbook_id", "skipped_part_count", "has_workbook_protection").join(
        totals, "workbook_id"
    )


def workbook_findings(rollup: DataFrame) -> DataFrame:
    path = F.lit("$.workbook")
    rules = [
        (F.col("skipped_part_count") > 0, "WORKBOOK_XML_PART_SCAN_SKIPPED"),
        (F.col("hidden_sheet_count") > 0, "WORKBOOK_HIDDEN_SHEET_PRESENT"),
        (F.col("very_hidden_sheet_count") > 0, "WORKBOOK_VERY_HIDDEN_SHEET_PRESENT"),
        (F.col("formula_cell_count") > 0, "WORKBOOK_FORMULA_PRESENT"),
        (
            F.col("has_sheet_protection") | F.col("has_workbook_protection"),
            "WORKBOOK_PROTECTION_ENABLED",
        ),
    ]
    return findings_of(rollup, "workbook_id", [(c, finding(code, path)) for c, code in rules])


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code").agg(F.count(F.lit(1)).alias("finding_count"))


def inspection_summary(workbooks: DataFrame, findings: DataFrame) -> DataFrame:
    """Per workbook: ready only when verified and free of findings; otherwise review."""
    counts = findings.groupBy(F.col("subject_id").alias("workbook_id")).agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.count_if(F.col("severity") == ERROR).alias("error_count"),
    )
    total = F.coalesce(F.col("finding_count"), F.lit(0)).cast("bigint")
    verified = F.col("provenance_verified")
    return workbooks.join(counts, "workbook_id", "left").select(
        "workbook_id",
        verified.alias("provenance_verified"),
        total.alias("finding_count"),
        F.coalesce(F.col("error_count"), F.lit(0)).cast("bigint").alias("error_count"),
        (verified & (total == 0)).alias("normalization_ready"),
        (~verified | (total > 0)).alias("human_review_required"),
    )


def inspection_gate(
    summary: DataFrame, rollup: DataFrame, options: InspectionOptions
) -> DataFrame:
    """Accept or reject per workbook; a workbook without a roll-up was not inspected."""
    joined = summary.join(
        rollup.select("workbook_id", "formula_cell_count", "skipped_part_count"),
        "workbook_id", "left",
    )
    completed = F.col("formula_cell_count").isNotNull()
    formulas = F.lit(options.fail_on_formulas) & (F.col("formula_cell_count") > 0)
    skipped = F.lit(options.fail_on_unsupported_feature) & (F.col("skipped_part_count") > 0)
    return joined.select(
        "workbook_id",
        completed.alias("inspection_completed"),
        F.coalesce(completed & (F.col("error_count") == 0) & ~formulas & ~skipped, F.lit(False))
        .alias("accepted"),
    )


@dataclass(frozen=True)
class Inspection:
    """Everything a report says: sheets, workbooks, findings, and whether each workbook is accepted."""

    profile: DataFrame
    rollup: DataFrame
    findings: DataFrame
    summary: DataFrame
    gate: DataFrame


def inspect(
    grid: DataFrame, structure: DataFrame, workbooks: DataFrame, options: InspectionOptions
) -> Inspection:
    """Profile, roll-up, findings, summary and gate; the grid is read once.

    The profile (a row per sheet) and the roll-up (a row per workbook) are written once, since the
    others read them several times.
    """
    profile = staged(sheet_profile(grid, structure, options), "profile")
    rollup = staged(workbook_rollup(profile, workbooks), "rollup")
    found = sheet_findings(profile, options).unionByName(workbook_findings(rollup))
    summary = inspection_summary(workbooks, found)
    return Inspection(profile, rollup, found, summary, inspection_gate(summary, rollup, options))


# --- containers -----------------------------------------------------------------------------------

CONTENT_TYPES, WORKBOOK_PART = "[Content_Types].xml", "xl/workbook.xml"
WORKBOOK_RELS = "xl/_rels/workbook.xml.rels"


def container_profile(parts: DataFrame) -> DataFrame:
    """Counts and flags per container, from entry names, sizes, flag bits and two texts."""
    name = F.col("entry_name")
    text = F.coalesce(F.col("text"), F.lit(""))

    def prefixed(prefix: str) -> Column:
        return F.count_if(name.startswith(prefix))

    links = F.sum(
        F.when(name == WORKBOOK_RELS, F.regexp_count(text, F.lit(r'Type="[^"]*/externalLink"')))
    )
    macro = (
        name.endswith("vbaProject.bin")
        | ((name == CONTENT_TYPES) & text.contains("macroEnabled"))
        | ((name == WORKBOOK_RELS) & text.contains("vbaProject"))
    )
    ratio = F.sum("file_size") / F.greatest(F.sum("compress_size"), F.lit(1))
    profile = parts.groupBy("workbook_id").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.sum("compress_size").alias("total_compressed_size"),
        F.sum("file_size").alias("total_uncompressed_size"),
        F.max("file_size").alias("max_entry_uncompressed_size"),
        F.bround(ratio, 4).alias("compression_ratio"),
        F.count_if(F.col("flag_bits").bitwiseAND(1) == 1).alias("encrypted_entry_count"),
        F.bool_or(macro).alias("macro_detected"),
        prefixed("xl/externalLinks/").alias("external_link_part_count"),
        F.coalesce(links, F.lit(0)).cast("bigint").alias("external_link_relationship_count"),
        (prefixed("xl/embeddings/") + F.count_if(name.contains("oleObject"))).alias(
            "embedded_object_part_count"
        ),
        prefixed("xl/activeX/").alias("activex_part_count"),
        prefixed("customXml/").alias("custom_xml_part_count"),
        prefixed("_xmlsignatures/").alias("digital_signature_part_count"),
        F.count_if(name.startswith("xl/drawings/") & ~name.contains("_rels")).alias(
            "drawing_part_count"
        ),
        F.count_if(name.rlike(r"\Axl/comments(?:/comment)?\d*\.xml\z")).alias(
            "comment_part_count"
        ),
        (F.bool_or(name == CONTENT_TYPES) & F.bool_or(name == WORKBOOK_PART)).alias(
            "required_parts_present"
        ),
        F.bool_or(is_traversal_entry("entry_name")).alias("traversal_entry"),
    )
    return profile.withColumn(
        "external_link_detected",
        (F.col("external_link_part_count") + F.col("external_link_relationship_count")) > 0,
    )


def container_findings(parts: DataFrame, options: InspectionOptions) -> DataFrame:
    """Findings per container with `fatal` telling whether it must not be opened."""
    repeated = (
        parts.groupBy("workbook_id", "entry_name").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("workbook_id").agg((F.max("n") > 1).alias("duplicate_entry"))
    )
    profile = container_profile(parts).join(repeated, "workbook_id")
    links, macros = options.fail_on_external_links, options.fail_on_macros
    objects = options.fail_on_embedded_objects
    rules = [
        (~F.col("required_parts_present"), "XLSX_REQUIRED_PART_MISSING", True),
        (F.col("traversal_entry"), "XLSX_PATH_TRAVERSAL_ENTRY", True),
        (F.col("duplicate_entry"), "XLSX_DUPLICATE_ENTRY", True),
        (F.col("encrypted_entry_count") > 0, "XLSX_ENCRYPTED_ENTRY", True),
        (F.col("macro_detected"), "WORKBOOK_MACRO_DETECTED", macros),
        (F.col("external_link_detected"), "WORKBOOK_EXTERNAL_LINK_DETECTED", links),
        (F.col("embedded_object_part_count") > 0, "WORKBOOK_EMBEDDED_OBJECT_DETECTED", objects),
        (F.col("activex_part_count") > 0, "WORKBOOK_ACTIVEX_DETECTED", objects),
        (F.col("custom_xml_part_count") > 0, "WORKBOOK_CUSTOM_XML_PRESENT", False),
        (F.col("digital_signature_part_count") > 0, "WORKBOOK_DIGITAL_SIGNATURE_PRESENT", False),
    ]
    path = F.lit("$.zipContainer")
    bodies = [(c, finding(code, path, ERROR if fatal else WARNING)) for c, code, fatal in rules]
    found = findings_of(profile, "workbook_id", bodies)
    return found.withColumn("fatal", F.col("severity") == ERROR)
