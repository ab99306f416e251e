"""Logging policy per data classification."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mask_by_classification(value: Column, classification: Column) -> Column:
    """public raw, internal masked, confidential digest only, secret (or unknown) never."""
    return (
        F.when(classification == "public", value)
        .when(classification == "internal", F.mask(value))
        .when(classification == "confidential", F.sha2(value, 256))
        .otherwise(F.lit(None).cast("string"))
    )
