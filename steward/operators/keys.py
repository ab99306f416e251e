"""Duplicate keys, first occurrences and running numbers.

None of these sorts a whole group in one task: a group may hold a third of all rows. First
occurrences come from a map-side combined `min` and a join that also carries the position, so the
join key is unique and spreads evenly; running numbers are computed per bounded bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from steward.functions.paths import sheet_ordinal_from_path


def mark_first(df: DataFrame, keys: list[str], position: str, name: str) -> DataFrame:
    """`df` with a flag on the first occurrence per key, from one join; `position` is unique within a key."""
    firsts = df.groupBy(*[F.col(k).alias(f"_its_{k}") for k in keys]).agg(F.min(position).alias("_first"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_its_{k}")) for k in keys]) & (F.col(position) == F.col("_first"))
    return df.join(firsts, on, "left").select(*df.columns, F.col("_first").isNotNull().alias(name))


def split_first(
    df: DataFrame, keys: list[str], position: str
) -> tuple[DataFrame, DataFrame]:
    """`(first occurrence per key, later occurrences)`; `position` is unique within a key."""
    marked = mark_first(df, keys, position, "_is_first")
    return marked.filter("_is_first").drop("_is_first"), marked.filter("NOT _is_first").drop("_is_first")


def first_per_key(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The whole first row per key in one combined aggregation."""
    rest = [c for c in df.columns if c not in keys]
    firsts = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("_row"))
    return firsts.select(*keys, "_row.*").select(*df.columns)


def number_rows(
    df: DataFrame, group: list[str], order: str, name: str, *, width: int = 1 << 18,
    keep: Column | None = None,
) -> DataFrame:
    """0-based running number of rows per group in `order` (a unique integer per group).

    Rows are numbered inside buckets of `width` consecutive order values and shifted by the size
    of the buckets before them, so a group of any size is numbered by many tasks. The bucket is a
    function of the row itself: a recomputed task reproduces it. `keep` drops rows before they
    are counted.
    """
    if keep is not None:
        df = df.filter(keep)
    bucketed = df.withColumn("_bucket", F.expr(f"`{order}` div {width}"))
    sizes = bucketed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *group, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(order)
    numbered = bucketed.withColumn("_n", F.row_number().over(inside))
    joined = numbered.join(offsets, [*group, "_bucket"])
    return joined.withColumn(name, (F.col("_offset") + F.col("_n") - 1).cast("bigint")).drop(
        "_bucket", "_offset", "_n"
    )


def duplicate_values(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Values occurring more than once within a group (null is a value)."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.filter("occurrences > 1")


def duplicate_sources(entries: DataFrame) -> DataFrame:
    """Repeated `source_id`s and `source_file`s per manifest, both kinds from one shuffle."""
    values = entries.select(
        "manifest_id",
        F.explode(
            F.array(
                F.struct(F.lit("source_id").alias("field"), F.col("source_id").alias("value")),
                F.struct(F.lit("source_file").alias("field"), F.col("source_file").alias("value")),
            )
        ).alias("v"),
    ).select("manifest_id", "v.*")
    return duplicate_values(values, ["manifest_id", "field"], "value")


def duplicate_authorization_keys(
    sheets: DataFrame, acks: DataFrame, reviews: DataFrame
) -> DataFrame:
    """Repeated sheet ordinals, (code, ordinal) acknowledgements and review ordinals."""
    nothing = F.lit(None).cast("string")
    keyed = [
        rows.select(
            "authorization_id", F.lit(kind).alias("kind"), code.alias("code"), "sheet_ordinal"
        )
        for kind, rows, code in (
            ("sheets", sheets, nothing),
            ("acknowledgedFindings", acks, F.col("code")),
            ("modelReferenceReviews", reviews, nothing),
        )
    ]
    every = keyed[0].unionByName(keyed[1]).unionByName(keyed[2])
    return duplicate_values(every, ["authorization_id", "kind", "code"], "sheet_ordinal")


def report_sheet_keys(
    sheets: DataFrame, prefix: str = "REPORT_SHEET_ORDINAL"
) -> tuple[DataFrame, DataFrame]:
    """`(usable report sheets, findings)`: bad ordinals and repeats drop out, the first stays.

    `prefix` names the caller's codes: the validator's `REPORT_SHEET_ORDINAL` or the
    normalizer's `INSPECTION_SHEET_ORDINAL`.
    """
    usable = F.coalesce(F.col("sheet_ordinal") >= 0, F.lit(False))
    firsts = sheets.filter(usable).groupBy(
        F.col("authorization_id").alias("_id"), F.col("sheet_ordinal").alias("_ordinal")
    ).agg(F.min("sheet_index").alias("_first"))
    on = (F.col("authorization_id").eqNullSafe(F.col("_id")) & (F.col("sheet_ordinal") == F.col("_ordinal"))
          & (F.col("sheet_index") == F.col("_first")))
    # One join marks the first sheets; all others are bad or repeated.
    marked = sheets.join(firsts, on, "left").drop("_id", "_ordinal")
    first = marked.filter("_first IS NOT NULL").drop("_first")
    code = F.when(~usable, F.lit(f"{prefix}_INVALID")).otherwise(F.lit(f"{prefix}_DUPLICATE"))
    findings = marked.filter("_first IS NULL").select(
        "authorization_id", F.lit("ERROR").alias("severity"), code.alias("code"),
        F.lit("$.report.sheets").alias("path"), "sheet_index",
    )
    return first, findings


def report_finding_keys(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(first finding per (code, sheet ordinal), findings about the repeats)`."""
    keyed = findings.withColumn("sheet_ordinal", sheet_ordinal_from_path(F.col("path")))
    first, repeated = split_first(
        keyed, ["authorization_id", "code", "sheet_ordinal"], "finding_index"
    )
    return first, repeated.select(
        "authorization_id", F.lit("ERROR").alias("severity"),
        F.lit("REPORT_FINDING_DUPLICATE").alias("code"),
        F.lit("$.report.findings").alias("path"), "finding_index",
    )
