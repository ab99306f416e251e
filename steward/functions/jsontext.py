"""JSON text columns: canonical output and strict shape tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def sorted_keys(value: Column, kind: T.DataType) -> Column:
    """`value` with the fields of every struct, and the entries of every map, in key order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[sorted_keys(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(value, lambda x: sorted_keys(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_keys(value), lambda k: k))
        return F.map_from_arrays(entries, F.transform(entries, lambda k: sorted_keys(value[k], kind.valueType)))
    return value


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One JSON text per row with keys sorted at every level and nulls kept."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(columns or df.columns)
    fields = [sorted_keys(F.col(f"`{n}`"), kinds[n]).alias(n) for n in names]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def is_single_json(text: Column) -> Column:
    """Exactly one well-formed JSON value.

    Spark's JSON functions stop at the end of the first value and ignore what follows. Trailing
    text shows once the value is wrapped: inside `[...]` and inside `{"k":...}` it breaks one of
    the two, whatever it is.
    """
    in_array = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.json_object_keys(F.concat(F.lit('{"k":'), text, F.lit("}")))
    return F.coalesce((in_array == 1) & (F.size(in_object) == 1), F.lit(False))


def is_json_object(text: Column) -> Column:
    return is_single_json(text) & F.json_object_keys(text).isNotNull()


def member(text: Column, key: str) -> Column:
    """Raw JSON text of a top-level member, null when absent."""
    return F.get_json_object(text, f"$['{key}']")
