"""Small literal grids for the tests."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

from steward.schemas import CELLS


class Formula(str):
    pass


class Error(str):
    pass


def cell(workbook, sheet, row, column, value):
    kind, values = "blank", [None, None, None, None]
    if isinstance(value, Formula):
        kind, values[0] = "formula", str(value)
    elif isinstance(value, Error):
        kind, values[0] = "error", str(value)
    elif isinstance(value, str):
        kind, values[0] = "string", value
    elif isinstance(value, bool):
        kind, values[2] = "boolean", value
    elif isinstance(value, (int, float)):
        kind, values[1] = "number", float(value)
    elif isinstance(value, dt.datetime):
        kind, values[3] = "date", value
    return (workbook, sheet, row, column, kind, *values)


def grid(spark, rows, workbook="WB", sheet=0):
    width = max(len(r) for r in rows)
    data = [
        cell(workbook, sheet, i, j, row[j - 1] if j <= len(row) else None)
        for i, row in enumerate(rows, start=1)
        for j in range(1, width + 1)
    ]
    return spark.createDataFrame(data, CELLS)


_STRUCTURE = dict(
    workbook_id="WB", sheet_ordinal=0, sheet_name="S", state="visible", declared_rows=3,
    declared_columns=4, merged_range_count=0, hidden_row_count=0, hidden_column_count=0,
    comment_count=0, hyperlink_count=0, data_validation_count=0, table_count=0, drawing_count=0,
    has_sheet_protection=False, merged_top_rows=0,
)


def structure(spark, **changes):
    row = {**_STRUCTURE, **changes}
    types = {str: "string", bool: "boolean", int: "int"}
    ddl = ", ".join(f"{k} {types[type(v)]}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], ddl)


def xlsx(sheet_xml, shared="<sst/>", workbook_extra="", styles=None):
    """A minimal workbook with one sheet."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("[Content_Types].xml", "<Types/>")
        archive.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns:r="r">{workbook_extra}<sheets>'
            '<sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        archive.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships><Relationship Id="rId1" Type="http://x/worksheet" '
            'Target="/xl/worksheets/sheet1.xml"/></Relationships>',
        )
        archive.writestr("xl/sharedStrings.xml", shared)
        if styles:
            archive.writestr("xl/styles.xml", styles)
        archive.writestr("xl/worksheets/sheet1.xml", sheet_xml)
    return buffer.getvalue()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
