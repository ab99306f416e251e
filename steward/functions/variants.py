"""JSON documents as VARIANT: parsed once, then read as maps, arrays and strictly typed values.

Of repeated keys the last one counts. Nothing is coerced: text is no number, a number is no flag.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F


def last_key_counts(spark: SparkSession) -> None:
    """Let the parser keep the last of repeated keys instead of refusing them."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def doubled(text: Column) -> Column:
    """A text parsed as the first of two array elements, the second being the text's digest; see `parsed`."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.sha2(text, 256), F.lit('"]'))).try_cast("array<variant>")


def parsed(text: Column, both: Column | None = None) -> Column:
    """Exactly one well-formed JSON value as VARIANT, else null. `both` is the doubled text where a column holds it already.

    The parser stops at the end of a value and ignores what follows. So the text is parsed as the first
    of two array elements, the second being the text's digest: what ends the array early can't hold it.
    """
    both = doubled(text) if both is None else both
    whole = (F.size(both) == 2) & (F.try_variant_get(F.get(both, F.lit(1)), "$", "string") == F.sha2(text, 256))
    return F.when(whole, F.get(both, F.lit(0)))


def members(value: Column) -> Column:
    """The members of an object as a map, null for anything else."""
    return value.try_cast("map<string,variant>")


def items(value: Column) -> Column:
    """The elements of an array, null for anything else."""
    return value.try_cast("array<variant>")


def member(of: Column, name: str) -> Column:
    return F.try_element_at(of, F.lit(name))


def kind(value: Column) -> Column:
    """The SQL type of a scalar. Of an array or object it would merge the types of all that is in it: see `is_array`."""
    return F.schema_of_variant(value)


def is_array(value: Column) -> Column:
    return items(value).isNotNull()


def fits(value: Column, as_type: str, of: Column | None = None) -> Column:
    """Whether a scalar has the type: `string`, `boolean`, `int` (an integral number of 32 bits) or `json int` (one written as such).

    `of` is the value's kind where the caller has it already.
    """
    of = kind(value) if of is None else of
    if as_type == "string":
        return of == "STRING"
    if as_type == "boolean":
        return of == "BOOLEAN"
    small = F.try_variant_get(value, "$", "int")
    if as_type == "json int":
        return (of == "BIGINT") & small.isNotNull()
    number = of.isin("BIGINT", "DOUBLE") | of.startswith("DECIMAL")
    return number & (F.try_variant_get(value, "$", "double") == small)


def scalar(value: Column, as_type: str, of: Column | None = None) -> Column:
    """The typed value where it fits, else null."""
    return F.when(fits(value, as_type, of), F.try_variant_get(value, "$", as_type.removeprefix("json ")))
