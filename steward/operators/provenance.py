"""Manifests against files, and evidence from verified entries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from steward.functions.paths import absolute_sql, normalize_segments, parent_segment_sql
from steward.functions.text import matches_sql
from steward.operators.contracts import provenance_invariant, row_errors
from steward.schemas import ERROR, SHA256_PATTERN
from steward.staging import staged


@dataclass(frozen=True)
class ManifestCheck:
    """`entries` of manifests that passed, all `findings`, one `manifests` row per manifest."""

    entries: DataFrame
    findings: DataFrame
    manifests: DataFrame


def _problem(condition: str, code: str, suffix: str = "") -> str:
    body = f"named_struct('code', '{code}', 'path', '$.sources.' || entry_index || '{suffix}')"
    return f"CASE WHEN {condition} THEN {body} END"


def _problems(rules: list[str]) -> Column:
    return F.expr(f"array_compact(array({', '.join(rules)}))")


def _contract_problems() -> Column:
    """Every field error of an entry, in field order."""
    names = ("source_id", "fal_version", "ontology_version", "profile_version", "source_file")
    hash_format = matches_sql("source_hash", SHA256_PATTERN)
    escapes = f"{absolute_sql('source_file')} OR {parent_segment_sql('source_file')}"
    return _problems(
        [
            *[_problem(f"{n} IS NULL OR {n} = ''", "MANIFEST_ENTRY_INVALID", f".{n}") for n in names],
            _problem(escapes, "SOURCE_PATH_OUTSIDE_BASE", ".source_file"),
            _problem("source_hash IS NULL", "MANIFEST_ENTRY_INVALID", ".source_hash"),
            _problem(f"NOT {hash_format}", "SOURCE_HASH_FORMAT_INVALID", ".source_hash"),
        ]
    )


def check_entries(entries: DataFrame, digests: DataFrame) -> DataFrame:
    """Entries with the array `problems`: forbidden field, else contract errors, else file checks."""
    contract = _contract_problems()
    judged = entries.withColumn(
        "problems",
        F.when(
            F.col("has_forbidden_field"),
            _problems([_problem("true", "MANIFEST_FORBIDDEN_FIELD")]),
        ).otherwise(contract),
    )
    # Only entries that are otherwise fine are looked up; the others get keys no path has, which spread them over
    # all tasks of the join (null keys would meet in one).
    nowhere = F.concat_ws(":", F.lit("\0"), "manifest_id", F.col("entry_index").cast("string"))
    lookup = F.when(F.size("problems") == 0, normalize_segments("source_file")).otherwise(nowhere)
    files = digests.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha256"))
    joined = judged.withColumn("_lookup", lookup).join(files, F.col("_lookup") == F.col("_path"), "left")
    file_problems = _problems(
        [
            _problem("_sha256 IS NULL", "SOURCE_FILE_NOT_FOUND", ".source_file"),
            _problem("source_hash <> _sha256", "SOURCE_HASH_MISMATCH", ".source_hash"),
        ]
    )
    return joined.withColumn(
        "problems", F.when(F.size("problems") > 0, F.col("problems")).otherwise(file_problems)
    ).drop("_lookup", "_path", "_sha256")


def verify_manifest(
    entries: DataFrame, digests: DataFrame, manifests: DataFrame
) -> ManifestCheck:
    """All-or-nothing verification of many manifests at once.

    A manifest passes when no entry has a problem, its version is at least 1, it lists something
    and repeats no source id or file. Per-manifest facts are combined sums and distinct counts;
    entries meet them again in a join AQE splits when one manifest is hot.
    """
    checked = staged(check_entries(entries, digests), "checked")  # read three times below
    facts = checked.groupBy("manifest_id").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.count_if(F.size("problems") > 0).alias("bad_entries"),
        F.count_distinct("source_id").alias("ids"),
        F.count_distinct("source_file").alias("files"),
    )
    n = F.coalesce(F.col("entry_count"), F.lit(0))
    contract = F.when(
        F.coalesce(F.col("bad_entries"), F.lit(0)) == 0,
        F.when(
            (F.col("version") < 1) | (n == 0),
            F.array_compact(
                F.array(F.when(F.col("version") < 1, "$.version"), F.when(n == 0, "$.sources"))
            ),
        ).when((F.col("ids") < n) | (F.col("files") < n), F.array(F.lit("$"))),
    )
    state = staged(manifests.join(facts, "manifest_id", "left").select(
        *manifests.columns,
        n.alias("entry_count"),
        contract.alias("_contract"),
        ((F.coalesce(F.col("bad_entries"), F.lit(0)) == 0) & contract.isNull()).alias("passed"),
    ), "manifests")
    entry_findings = checked.select(
        F.col("manifest_id").alias("subject_id"), F.explode("problems").alias("p")
    ).select("subject_id", F.lit(ERROR).alias("severity"), "p.code", "p.path")
    manifest_findings = state.select(
        F.col("manifest_id").alias("subject_id"), F.lit(ERROR).alias("severity"),
        F.lit("MANIFEST_CONTRACT_INVALID").alias("code"), F.explode("_contract").alias("path"),
    )
    passed = state.filter("passed").select("manifest_id")
    verified = (
        checked.join(passed, "manifest_id", "left_semi")
        .drop("problems", "has_forbidden_field")
        .withColumn("verified", F.lit(True))
        .withColumn("status", F.lit("approved"))
    )
    return ManifestCheck(
        verified, entry_findings.unionByName(manifest_findings), state.drop("_contract")
    )


def first_manifest_match(workbooks: DataFrame, entries: DataFrame) -> DataFrame:
    """The first verified entry, in manifest order, that names each workbook's file."""
    listed = entries.select(
        "manifest_id", normalize_segments("source_file").alias("path"), "entry_index",
        "source_id",
    )
    located = workbooks.select(
        "workbook_id", "manifest_id", normalize_segments("path").alias("path")
    )
    return (
        located.join(listed, ["manifest_id", "path"])
        .groupBy("workbook_id")
        .agg(F.min(F.struct("entry_index", "source_id")).alias("m"))
        .select("workbook_id", "m.entry_index", "m.source_id")
    )


def manifest_state(
    workbooks: DataFrame, check: ManifestCheck, allow_pending: bool = False
) -> DataFrame:
    """`verified`, `pending` or `invalid` per workbook, with the gate's own code.

    An invalid manifest's reasons are its own findings; `code` names only what the gate adds.
    """
    matched = first_manifest_match(workbooks, check.entries)
    states = check.manifests.select("manifest_id", "passed", "pending_shape")
    joined = workbooks.join(states, "manifest_id", "left").join(matched, "workbook_id", "left")
    passed = F.coalesce(F.col("passed"), F.lit(False))
    pending = ~passed & F.coalesce(F.col("pending_shape"), F.lit(False))
    listed = F.col("source_id").isNotNull()
    return joined.select(
        "workbook_id",
        F.when(passed & listed, "verified").when(pending, "pending").otherwise("invalid")
        .alias("manifest_state"),
        F.when(passed, F.col("source_id")).alias("source_id"),
        F.when(passed & ~listed, "WORKBOOK_NOT_IN_MANIFEST")
        .when(pending & F.lit(not allow_pending), "MANIFEST_NOT_VERIFIED")
        .alias("code"),
    )


def source_id_match(matches_: DataFrame, declared: DataFrame) -> DataFrame:
    """Workbooks whose report names another source than the manifest."""
    other = declared.select("workbook_id", F.col("source_id").alias("_declared"))
    joined = matches_.join(other, "workbook_id")
    return joined.filter(~F.col("source_id").eqNullSafe(F.col("_declared"))).select(
        F.col("workbook_id").alias("subject_id"), F.lit(ERROR).alias("severity"),
        F.lit("SOURCE_ID_MISMATCH").alias("code"),
    )


def check_provenance(entries: DataFrame) -> DataFrame:
    """First broken provenance invariant per entry."""
    return entries.select("entry_id", provenance_invariant().alias("problem")).filter(
        "problem is not null"
    )


def evidence_build(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(evidence, findings)` from manifest entries; only verified, approved entries give evidence."""
    errors = row_errors(entries, "SourceManifestEntry")

    def found(code: str, paths: Column) -> Column:
        return F.transform(paths, lambda p: F.struct(F.lit(code).alias("code"), p.alias("path")))

    problems = (
        F.when(F.size(errors) > 0, found("SOURCE_ENTRY_INVALID", errors))
        .when(provenance_invariant().isNotNull(), found("SOURCE_ENTRY_INVALID", F.array(F.lit("$"))))
        .when(~F.col("verified"), found("SOURCE_NOT_VERIFIED", F.array(F.lit("$.verified"))))
        .when(F.col("status") != "approved", found("SOURCE_NOT_APPROVED", F.array(F.lit("$.status"))))
    )
    judged = entries.withColumn("_problems", problems)
    evidence = judged.filter("_problems is null").select(
        F.concat(F.lit("evidence:"), F.col("source_id")).alias("evidence_id"),
        "fal_version", "ontology_version", "profile_version", "resource_uri", "source_file",
        "source_hash",
    )
    findings = judged.select(
        F.col("entry_id").alias("subject_id"), F.explode("_problems").alias("p")
    ).select("subject_id", F.lit(ERROR).alias("severity"), "p.code", "p.path")
    return evidence, findings
