"""Grids from typed tables: the scale path into every grid operator.

A grid has two shapes: rows (`workbook_id, sheet_ordinal, row_ordinal`, `cells`: an array of cells by column, raw or
classified) and single classified cells (with `column_ordinal`). Rows are what moves; cells are a view of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from steward.functions.cells import category
from steward.schemas import CELL_VALUE

_RAW_CELL = (
    "named_struct('raw_type', {kind}, 'date_format', {date_format}, "
    "'value_string', CAST({text} AS STRING), 'value_number', CAST({number} AS DOUBLE), "
    "'value_boolean', CAST({boolean} AS BOOLEAN), 'value_timestamp', CAST({time} AS TIMESTAMP))"
)
_LEADING_ROW = "array<struct<row_ordinal:bigint,cells:array<" + CELL_VALUE.simpleString() + ">>>"
ROW = ["workbook_id", "sheet_ordinal", "row_ordinal"]
VALUES = ("value_string", "value_number", "value_boolean", "value_timestamp")
_TYPES = ("STRING", "DOUBLE", "BOOLEAN", "TIMESTAMP")


def raw_cell(
    kind: str, text: str = "NULL", number: str = "NULL", boolean: str = "NULL",
    time: str = "NULL", date_format: str = "false",
) -> str:
    """SQL of one raw cell; every argument is a SQL expression."""
    return _RAW_CELL.format(
        kind=kind, text=text, number=number, boolean=boolean, time=time, date_format=date_format
    )


def leading_row(row_ordinal: str, cells: list[str]) -> str:
    """SQL of a title or header row for `melt_to_rows`."""
    return (
        f"named_struct('row_ordinal', CAST({row_ordinal} AS BIGINT), "
        f"'cells', array({', '.join(cells)}))"
    )


def raw_of(name: str, dtype: T.DataType) -> str:
    """A typed column as a raw cell; struct columns already are raw cells."""
    if isinstance(dtype, T.StructType):
        return name
    if isinstance(dtype, T.BooleanType):
        return raw_cell("'b'", boolean=name)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return raw_cell("'d'", time=name, date_format="true")
    if isinstance(dtype, (T.LongType, T.DecimalType)):
        # Digits that a double would round travel as text.
        exact = f"CAST({name} AS DECIMAL(38, {getattr(dtype, 'scale', 0)})) <=> try_cast(CAST({name} AS DOUBLE) AS DECIMAL(38, {getattr(dtype, 'scale', 0)}))"
        if isinstance(dtype, T.DecimalType) and dtype.precision <= 15:
            return raw_cell("'n'", number=name)
        return raw_cell("'n'", number=f"CASE WHEN {exact} THEN {name} END", text=f"CASE WHEN NOT {exact} THEN {name} END")
    if isinstance(dtype, T.NumericType):
        return raw_cell("'n'", number=name)
    return raw_cell("'s'", text=name)


def melt_to_rows(
    df: DataFrame,
    columns: dict[str, str] | list[str],
    *,
    leading_rows: Column | None = None,
) -> DataFrame:
    """Turn rows keyed by `workbook_id, sheet_ordinal, row_ordinal` into rows of a grid.

    A grid row keeps its cells together, in an array by column, so whatever concerns single rows
    needs no shuffle. `columns` lists typed columns, or maps labels to raw-cell SQL, in column order 1..n.
    `leading_rows` optionally holds, on the row that comes first in a sheet, an array of
    `leading_row`s.
    """
    if not isinstance(columns, dict):
        types = {f.name: f.dataType for f in df.schema.fields}
        columns = {c: raw_of(c, types[c]) for c in columns}
    own = leading_row("row_ordinal", list(columns.values()))
    keys = ("workbook_id", F.expr("CAST(sheet_ordinal AS INT) AS sheet_ordinal"))
    if leading_rows is None:
        return df.select(*keys, F.expr(own).alias("r")).select(*ROW[:2], "r.row_ordinal", "r.cells")
    before = F.coalesce(leading_rows, F.array().cast(_LEADING_ROW))
    return df.select(*keys, F.explode(F.concat(before, F.expr(f"array({own})"))).alias("r")).select(
        *ROW[:2], "r.row_ordinal", "r.cells")


def raw_cells(rows: DataFrame) -> bool:
    """Whether the cells of grid rows are raw, not classified."""
    return "raw_type" in rows.schema["cells"].dataType.elementType.fieldNames()


def kind_of(rows: DataFrame, at: str) -> str:
    """SQL of the category of a cell of `rows`, whose fields have the prefix `at`."""
    return category(at) if raw_cells(rows) else f"{at}cell_type"


def cells_of(rows: DataFrame, fold_inline: bool = False, classify: bool = True) -> DataFrame:
    """The cells of grid rows, one row each: a view that a filter on columns or types goes through.

    Raw cells are classified one by one: an expression per column would make methods too long to compile.
    """
    raw = raw_cells(rows)
    kind = [F.col("cell.raw_type"), F.col("cell.date_format")] if raw and not classify else [
        F.expr(category("cell.", fold_inline) if raw else "cell.cell_type").alias("cell_type")]
    exploded = rows.select(*ROW, F.posexplode("cells").alias("position", "cell"))
    return exploded.select(*ROW, F.expr("position + 1 AS column_ordinal"), *kind, *[f"cell.{v}" for v in VALUES])


def rows_of(grid: DataFrame) -> DataFrame:
    """Grid rows, whichever shape `grid` has. Single cells are gathered by row, which a sheet's width bounds;
    a column that a row leaves out is blank."""
    if "cells" in grid.columns:
        return grid
    fields = ("cell_type", *VALUES)
    blank = F.expr("named_struct('cell_type', 'blank', " + ", ".join(f"'{v}', CAST(NULL AS {t})" for v, t in zip(VALUES, _TYPES, strict=True)) + ")")
    gathered = grid.groupBy(*ROW).agg(
        F.map_from_entries(F.collect_list(F.struct("column_ordinal", F.struct(*fields)))).alias("by_column"), F.max("column_ordinal").alias("width"))
    return gathered.select(*ROW, F.transform(F.sequence(F.lit(1), "width"), lambda i: F.coalesce(F.try_element_at("by_column", i), blank)).alias("cells"))


def melt_to_cells(
    df: DataFrame,
    columns: dict[str, str] | list[str],
    *,
    leading_rows: Column | None = None,
    fold_inline: bool = False,
    classify: bool = True,
) -> DataFrame:
    """`melt_to_rows` seen cell by cell."""
    return cells_of(melt_to_rows(df, columns, leading_rows=leading_rows), fold_inline, classify)
