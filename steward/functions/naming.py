"""snake_case and camelCase spellings of governed column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def to_camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part[:1].upper() + part[1:] for part in rest)


def to_snake(name: str) -> str:
    return "".join(f"_{ch.lower()}" if ch.isupper() else ch for ch in name)


def _renamed_type(dtype: T.DataType, rename) -> T.DataType:
    if isinstance(dtype, T.StructType):
        return T.StructType(
            [T.StructField(rename(f.name), _renamed_type(f.dataType, rename), f.nullable)
             for f in dtype.fields]
        )
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_renamed_type(dtype.elementType, rename), dtype.containsNull)
    return dtype


def alias_columns(df: DataFrame, style: str = "camel") -> DataFrame:
    """Rename every column, nested struct fields included, to one spelling.

    A struct-to-struct cast is positional, so nested renames cost nothing at run time. When both
    spellings of a column are present, the first non-null one is kept.
    """
    rename = {"camel": to_camel, "snake": to_snake}[style]
    groups: dict[str, list[T.StructField]] = {}
    for field in df.schema.fields:
        groups.setdefault(rename(field.name), []).append(field)
    columns: list[Column] = []
    for name, fields in groups.items():
        values = [F.col(f"`{f.name}`").cast(_renamed_type(f.dataType, rename)) for f in fields]
        columns.append((values[0] if len(values) == 1 else F.coalesce(*values)).alias(name))
    return df.select(*columns)
