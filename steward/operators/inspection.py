"""Inspection of workbooks from their bytes: gate by gate, each workbook as far as it gets.

`states` says what the manifest gate found (`operators.provenance.manifest_state`). A workbook of an invalid or
unaccepted manifest isn't opened; a container with a fatal finding isn't read further; one that can't
be loaded has no sheets. What remains is profiled, and every workbook gets a summary and a verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from steward.operators import profile as pf, structure as st
from steward.schemas import ERROR, WARNING
from steward.sources.workbooks import scan_workbooks
from steward.staging import staged


def _ids(df: DataFrame, name: str = "subject_id") -> DataFrame:
    return df.select(F.col(name).alias("workbook_id")).distinct()


def inspect_workbooks(
    files: DataFrame, states: DataFrame, options: pf.InspectionOptions, read_limit: int | None = None
) -> pf.Inspection:
    """Profile, roll-up, findings, summary and gate of every workbook in `files` (workbook_id, content).

    `states` holds `workbook_id, manifest_state, code` (the gate's own code, if any). A file without a state
    counts as one of an invalid manifest. The files are read once; the grid and the parts are tables then.
    """
    known = files.select("workbook_id").join(states.select("workbook_id", "manifest_state", "code"), "workbook_id", "left")
    accepted = ["verified", *(["pending"] if options.allow_pending_manifest else [])]
    state = F.coalesce("manifest_state", F.lit("invalid"))
    gated = staged(known.select("workbook_id", state.alias("manifest_state"), state.isin(accepted).alias("opened"), "code"), "states")
    opened = gated.filter("opened").select("workbook_id")
    scanned = scan_workbooks(
        files.join(opened, "workbook_id", "left_semi"), options.max_rows_per_sheet, options.max_columns_per_sheet, read_limit)

    refused = gated.filter("NOT opened").select(
        F.col("workbook_id").alias("subject_id"), F.lit(ERROR).alias("severity"),
        F.coalesce("code", F.when(F.col("manifest_state") == "pending", "MANIFEST_NOT_VERIFIED").otherwise("MANIFEST_INVALID")).alias("code"),
        F.lit("$.manifest").alias("path"))
    container = staged(pf.container_findings(scanned.parts, options).unionByName(
        scanned.container_findings.withColumn("fatal", F.lit(True))), "container")
    closed = _ids(container.filter("fatal"))
    readable = staged(_ids(scanned.parts, "workbook_id").join(closed, "workbook_id", "left_anti"), "readable")
    failed = scanned.load_findings.select(F.col("subject_id").alias("workbook_id")).join(readable, "workbook_id", "left_semi")
    loaded = readable.join(failed, "workbook_id", "left_anti")
    parts = scanned.parts.join(readable, "workbook_id", "left_semi")
    books = st.workbook_structure(parts)

    facts = books.join(loaded, "workbook_id", "left_semi")
    sheets = st.sheet_structure(parts).join(loaded, "workbook_id", "left_semi")
    grid = scanned.rows.join(loaded, "workbook_id", "left_semi")
    inspected = pf.inspect(grid, sheets, facts.withColumn("provenance_verified", F.lit(True)), options)
    skipped = books.filter("skipped_part_count > 0").join(failed, "workbook_id", "left_semi").select(
        F.col("workbook_id").alias("subject_id"), F.lit(WARNING).alias("severity"), F.lit("WORKBOOK_XML_PART_SCAN_SKIPPED").alias("code"),
        F.lit("$.workbook").alias("path"))
    unloaded = failed.select(
        F.col("workbook_id").alias("subject_id"), F.lit(ERROR).alias("severity"), F.lit("WORKBOOK_LOAD_FAILED").alias("code"),
        F.lit("$").alias("path"))
    found = refused.unionByName(container.drop("fatal"))
    for more in (skipped, unloaded, inspected.findings):
        found = found.unionByName(more.select("subject_id", "severity", "code", "path"))
    found = staged(found, "findings")

    verified = gated.select("workbook_id", (F.col("manifest_state") == "verified").alias("provenance_verified"))
    summary = pf.inspection_summary(verified, found)
    return pf.Inspection(inspected.profile, inspected.rollup, found, summary, pf.inspection_gate(summary, inspected.rollup, options))
