"""Results, evidence and governance decisions in long form.

A result or decision is spread over child tables (findings, references, evidence items) instead
of nested arrays: one decision may own a third of all items, and no list of them is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from steward.operators import contracts
from steward.operators.keys import split_first
from steward.schemas import ERROR
from steward.staging import staged

EVIDENCE_CONTENT = (
    "fal_version", "ontology_version", "profile_version", "resource_uri", "source_file",
    "source_hash",
)


def result_tables(results: DataFrame) -> dict[str, DataFrame]:
    """Child tables of nested result rows (`result_id`, `errors`, `warnings`, `evidence`)."""
    lists = F.array(
        *[F.struct(F.lit(n).alias("list_name"), F.col(n).alias("items")) for n in ("errors", "warnings")]
    )
    findings = results.select("result_id", F.explode(lists).alias("l")).select(
        "result_id", "l.list_name", F.posexplode("l.items").alias("finding_index", "f")
    )
    evidence = results.select("result_id", F.posexplode("evidence").alias("item_index", "e"))
    return {
        "findings": findings.select("result_id", "list_name", "finding_index", "f.*"),
        "refs": findings.select(
            "result_id", "list_name", "finding_index", F.explode("f.evidence_refs").alias("ref")
        ),
        "evidence": evidence.select("result_id", "item_index", "e.*"),
    }


def _list_counts(findings: DataFrame) -> DataFrame:
    in_errors, in_warnings = F.col("list_name") == "errors", F.col("list_name") == "warnings"
    return findings.groupBy("result_id").agg(
        F.count_if(in_errors).alias("n_errors"),
        F.count_if(in_warnings).alias("n_warnings"),
        F.count_if(in_errors & (F.col("severity") != "ERROR")).alias("bad_errors"),
        F.count_if(in_warnings & (F.col("severity") != "WARNING")).alias("bad_warnings"),
    )


def check_result_severity(findings: DataFrame) -> DataFrame:
    """Results with a finding of the wrong severity in one of their lists."""
    problem = contracts.severity_invariant("bad_errors", "bad_warnings")
    return _list_counts(findings).select("result_id", problem.alias("problem")).filter(
        "problem is not null"
    )


def check_result_status(results: DataFrame, findings: DataFrame) -> DataFrame:
    """Results whose status contradicts their lists or the review flag."""
    joined = results.join(_list_counts(findings), "result_id", "left")
    sizes = [f"coalesce({c}, 0)" for c in ("n_errors", "n_warnings")]
    return joined.select("result_id", contracts.status_invariant(*sizes).alias("problem")).filter(
        "problem is not null"
    )


def check_evidence_refs(evidence: DataFrame, refs: DataFrame) -> DataFrame:
    """Repeated evidence ids within a result, and references to ids it does not have."""
    counted = evidence.groupBy("result_id", "evidence_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = counted.filter("n > 1").select(
        "result_id", F.lit("duplicate_evidence_id").alias("problem"), "evidence_id"
    )
    dangling = (
        refs.select("result_id", F.col("ref").alias("evidence_id"))
        .distinct()
        .join(counted, ["result_id", "evidence_id"], "left_anti")
        .select("result_id", F.lit("dangling_reference").alias("problem"), "evidence_id")
    )
    return repeated.unionByName(dangling)


# --- evidence of decisions ------------------------------------------------------------------------


def _passed() -> Column:
    return F.coalesce((F.col("status") == "PASS") & ~F.coalesce(F.col("has_errors"), F.lit(False)), F.lit(False))


def successful_evidence_results(
    results: DataFrame, items: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """`(results that count, findings)`: PASS, no errors and at least one evidence item."""
    keys = ["decision_id", "result_index"]
    owned = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_items"))
    judged = results.join(owned, keys, "left").withColumn("_good", _passed() & F.col("_n_items").isNotNull())
    findings = judged.filter(~F.col("_good")).select(
        "decision_id", F.lit(ERROR).alias("severity"),
        F.lit("EVIDENCE_RESULT_NOT_SUCCESSFUL").alias("code"),
        F.concat(F.lit("$.evidenceResults."), F.col("result_index").cast("string")).alias("path"),
    )
    return judged.filter("_good").select(*keys), findings


def usable_items(results: DataFrame, items: DataFrame) -> DataFrame:
    """Items of results that count. A result with an item has one, so its items needn't be counted."""
    return items.join(results.filter(_passed()), ["decision_id", "result_index"], "left_semi")


def _ordered(items: DataFrame) -> DataFrame:
    content = [c for c in EVIDENCE_CONTENT if c in items.columns]
    return items.withColumn("_at", F.struct("result_index", "item_index")).withColumn(
        "_content", F.struct(*content)
    )


def first_evidence(items: DataFrame) -> DataFrame:
    """The first item per evidence id of a decision; `(result_index, item_index)` keeps the order."""
    return split_first(_ordered(items), ["decision_id", "evidence_id"], "_at")[0].drop(
        "_at", "_content"
    )


def marked_evidence(items: DataFrame) -> DataFrame:
    """`items` with `is_first`, the first item of its evidence id, and `conflicts`, content unlike that item's.

    One combined aggregate holds the state of an evidence id, its first position with that item's digest;
    each item is compared with the state of its id. Items without an id, or of no decision, conflict with
    nothing.
    """
    content = F.to_json("_content", {"ignoreNullFields": "false"})
    digested = _ordered(items).withColumn("_digest", F.sha2(content, 256)).drop("_content")
    state = digested.groupBy(
        F.col("decision_id").alias("_decision"), F.col("evidence_id").alias("_evidence")
    ).agg(F.min(F.struct("_at", "_digest")).alias("_first"))
    same = F.col("decision_id").eqNullSafe(F.col("_decision")) & F.col("evidence_id").eqNullSafe(F.col("_evidence"))
    named = F.col("decision_id").isNotNull() & F.col("evidence_id").isNotNull()
    return digested.join(state, same).select(
        *items.columns, (F.col("_at") == F.col("_first._at")).alias("is_first"),
        (named & (F.col("_digest") != F.col("_first._digest"))).alias("conflicts"),
    )


def _conflict_findings(marked: DataFrame) -> DataFrame:
    return marked.filter("conflicts").select(
        "decision_id", F.lit(ERROR).alias("severity"), F.lit("EVIDENCE_ID_CONFLICT").alias("code"),
        F.concat(F.lit("$.evidenceResults."), F.col("result_index").cast("string")).alias("path"),
        "evidence_id", "result_index", "item_index",
    )


def evidence_conflicts(items: DataFrame) -> DataFrame:
    """Later items whose content differs from the first item with the same id."""
    return _conflict_findings(marked_evidence(items))


def check_decision(
    decisions: DataFrame, findings: DataFrame, source_results: DataFrame
) -> DataFrame:
    """First contradiction between a decision's status and what supports it."""
    facts = _facts(_finding_facts(findings), _source_facts(source_results))
    return _judged(decisions, facts).filter("_problem is not null").select(
        "decision_id", F.col("_problem").alias("problem")
    )


#: What is counted per decision.
_FACTS = ("_n_findings", "_n_errors", "_n_failed", "_n_bad", "_n_evidence", "_n_dangling")


def _counted(rows: DataFrame, **facts: Column) -> DataFrame:
    """A row of counts for each row; `facts` are conditions."""
    return rows.select(
        "decision_id",
        *[F.coalesce(facts.get(n, F.lit(False)).cast("bigint"), F.lit(0).cast("bigint")).alias(n) for n in _FACTS],
    )


def _finding_facts(findings: DataFrame) -> DataFrame:
    return _counted(findings, _n_findings=F.lit(True), _n_errors=F.col("severity") == ERROR)


def _source_facts(source_results: DataFrame) -> DataFrame:
    return _counted(source_results, _n_failed=F.col("status") == "FAIL")


def _facts(*parts: DataFrame) -> DataFrame:
    """All counts of a decision in one combined aggregate over everything that concerns it."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("decision_id").agg(*[F.sum(n).alias(n) for n in _FACTS])


def _judged(decisions: DataFrame, facts: DataFrame) -> DataFrame:
    counts = [f"coalesce({c}, 0)" for c in ("_n_findings", "_n_errors", "_n_failed")]
    errors = contracts.row_errors(decisions, "Decision")
    return decisions.join(facts, "decision_id", "left").select(
        *decisions.columns, *_FACTS,
        errors.alias("_field_errors"),
        F.when(F.size(errors) == 0, contracts.decision_invariant(*counts)).alias("_problem"),
    )


def assemble_decisions(
    decisions: DataFrame, findings: DataFrame, refs: DataFrame, source_results: DataFrame,
    evidence_results: DataFrame, items: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(assembled decisions, their merged evidence, findings)`.

    Evidence errors end a decision, then missing evidence, then field errors or the first broken
    invariant. A rejected decision assembles like any other: its status is given, never inferred.

    The marked items, and the judged decisions, are written once and read by all three results; the counts
    of a decision come from one aggregate over findings, results, items and dangling references.
    """
    marked = staged(marked_evidence(usable_items(evidence_results, items)), "evidence")
    # Only results that count have marked items.
    unsuccessful = successful_evidence_results(evidence_results, marked)[1]
    conflicts = _conflict_findings(marked).select("decision_id", "severity", "code", "path")
    evidence_findings = unsuccessful.unionByName(conflicts)
    firsts = marked.filter("is_first")
    dangling = refs.select("decision_id", "ref").join(
        firsts.select("decision_id", F.col("evidence_id").alias("ref")), ["decision_id", "ref"], "left_anti"
    )
    facts = _facts(
        _finding_facts(findings), _source_facts(source_results), _counted(unsuccessful, _n_bad=F.lit(True)),
        _counted(marked, _n_bad=F.col("conflicts"), _n_evidence=F.col("is_first")),
        _counted(dangling, _n_dangling=F.lit(True)),
    )
    count = F.coalesce(F.col("_n_evidence"), F.lit(0)).cast("bigint")
    invalid = F.col("_problem").isNotNull() | (F.coalesce(F.col("_n_dangling"), F.lit(0)) > 0)

    def found(code: str, paths: Column) -> Column:
        return F.transform(paths, lambda p: F.struct(F.lit(code).alias("code"), p.alias("path")))

    own = (
        F.when(F.col("_n_bad") > 0, F.array().cast("array<struct<code:string,path:string>>"))
        .when(count == 0, found("GOVERNANCE_EVIDENCE_REQUIRED", F.array(F.lit("$.evidenceResults"))))
        .when(F.size("_field_errors") > 0, found("GOVERNANCE_RESULT_INVALID", F.col("_field_errors")))
        .when(invalid, found("GOVERNANCE_RESULT_INVALID", F.array(F.lit("$"))))
    )
    judged = staged(
        _judged(decisions, facts).select(*decisions.columns, own.alias("_own"), count.alias("_count")), "decisions"
    )
    assembled = judged.filter("_own is null").select(
        *decisions.columns, F.col("_count").alias("evidence_count")
    )
    own_findings = judged.select("decision_id", F.explode("_own").alias("f")).select(
        "decision_id", F.lit(ERROR).alias("severity"), "f.code", "f.path"
    )
    evidence = firsts.select(*items.columns).join(assembled.select("decision_id"), "decision_id", "left_semi")
    return assembled, evidence, evidence_findings.unionByName(own_findings)


# --- sets of findings and artifacts ---------------------------------------------------------------


def union_findings(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """Findings of several checks in one table; `check_order` keeps the checks' order."""
    parts = [
        df.select(
            "subject_id", "severity", "code", "path",
            F.lit(i).alias("check_order"), F.lit(name).alias("check_name"),
        )
        for i, (name, df) in enumerate(checks)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def snapshot_drift(generated: DataFrame, committed: DataFrame) -> DataFrame:
    """Generated artifacts that are missing or different in the committed set.

    Only names and digests are shuffled; extra committed artifacts are ignored.
    """
    left = generated.select("name", F.sha2("content", 256).alias("digest"))
    right = committed.select("name", F.sha2("content", 256).alias("_committed"))
    joined = left.join(right, "name", "left")
    return joined.filter(
        F.col("_committed").isNull() | (F.col("digest") != F.col("_committed"))
    ).select("name", F.when(F.col("_committed").isNull(), "missing").otherwise("different").alias("drift"))
