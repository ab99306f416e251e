"""Cell classification and typed value extraction.

A raw cell is the column group `raw_type, date_format, value_string, value_number, value_boolean,
value_timestamp`; a classified cell replaces the first two by `cell_type`. The rules are SQL
expressions over those columns; `at` is the prefix of the struct they sit in (`"cell."`), if any.

A number that a double cannot hold exactly is never rounded: its cell has a null `value_number` and its
digits in `value_string`. It can be taken as an integer of up to 64 bits, and is rejected as a number.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from steward.functions.text import strip
from steward.schemas import VALUE_TYPES

_CATEGORY = """
CASE WHEN {at}value_string IS NULL AND {at}value_number IS NULL
          AND {at}value_boolean IS NULL AND {at}value_timestamp IS NULL THEN 'blank'
     WHEN {at}raw_type = 'f' THEN 'formula'
     WHEN {at}raw_type = 'e' THEN 'error'
     WHEN {at}raw_type = 'b' THEN 'boolean'
     WHEN {at}value_string IS NULL
          AND ({at}raw_type = 'd' OR ({at}raw_type = 'n' AND {at}date_format)) THEN 'date'
     WHEN {at}raw_type = 'n' THEN 'number'
     WHEN {at}raw_type = 'inlineStr' THEN '{inline}'
     WHEN {at}raw_type IN ('s', 'str') THEN 'string'
     ELSE 'unknown' END
"""

#: What a classified cell must look like to be taken as each value type. Nothing is coerced: text
#: never becomes a number, a boolean is never a number.
_FITS = {
    "string": "{at}cell_type IN ('string', 'inline_string')",
    "number": "{at}cell_type = 'number' AND {at}value_number IS NOT NULL",
    "integer": "{at}cell_type = 'number' AND CASE WHEN {at}value_number IS NULL "
               "THEN rlike({at}value_string, '^-?[0-9]+$') AND try_cast({at}value_string AS BIGINT) IS NOT NULL "
               "ELSE {at}value_number % 1 = 0 AND try_cast({at}value_number AS BIGINT) IS NOT NULL END",
    "boolean": "{at}cell_type = 'boolean'",
    "date": "{at}cell_type = 'date' AND {at}value_timestamp IS NOT NULL",
}
_REJECT = """
CASE {at}cell_type WHEN 'blank' THEN NULL
     WHEN 'formula' THEN 'FORMULA_VALUE_PROHIBITED'
     WHEN 'error' THEN 'ERROR_CELL_PROHIBITED'
     WHEN 'unknown' THEN 'UNKNOWN_CELL_TYPE'
     ELSE CASE WHEN coalesce({fits}, false) THEN NULL ELSE 'VALUE_TYPE_MISMATCH' END END
"""
TYPED_FIELDS = {
    "string": "value_string",
    "number": "value_number",
    "integer": "value_integer",
    "boolean": "value_boolean",
    "date": "value_date",
}


def category(at: str = "", fold_inline: bool = False) -> str:
    """SQL of the category of a raw cell; `fold_inline` counts inline strings as strings."""
    return _CATEGORY.format(at=at, inline="string" if fold_inline else "inline_string")


def classify_cell(at: str = "", fold_inline: bool = False) -> Column:
    return F.expr(category(at, fold_inline))


def reject_code(value_type: str, at: str = "") -> Column:
    """Why a classified cell cannot be taken as `value_type`; null when it can."""
    return F.expr(_REJECT.format(at=at, fits=_FITS[value_type].format(at=at)))


def typed_value(value_type: str, at: str = "") -> Column:
    """The value of an acceptable cell in the Spark type of `value_type`."""
    if value_type == "string":
        return F.nullif(strip(F.col(f"{at}value_string")), F.lit(""))
    if value_type == "number":
        return F.col(f"{at}value_number")
    if value_type == "integer":
        return F.expr(f"CASE WHEN {at}value_number IS NULL THEN try_cast({at}value_string AS BIGINT) "
                      f"ELSE try_cast({at}value_number AS BIGINT) END")
    if value_type == "boolean":
        return F.col(f"{at}value_boolean")
    if value_type == "date":
        return F.expr(f"CAST({at}value_timestamp AS DATE)")
    raise ValueError(f"value type must be one of {VALUE_TYPES}")


def normalize_value(value_type: Column, at: str = "") -> Column:
    """Struct of one typed value per value type plus `reject_code`, for a type per row."""
    rejected = F.lit("VALUE_TYPE_MISMATCH")
    for kind in VALUE_TYPES:
        rejected = F.when(value_type == kind, reject_code(kind, at)).otherwise(rejected)
    fields = [
        F.when((value_type == kind) & rejected.isNull(), typed_value(kind, at)).alias(name)
        for kind, name in TYPED_FIELDS.items()
    ]
    return F.struct(*fields, rejected.alias("reject_code"))
