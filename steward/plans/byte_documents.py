"""YAML and XLSX bytes derived from the driver tables, as inputs of the scanner queries.

Grouping is by blocks of consecutive keys (ten documents, a hundred orders), so a document's size
is bounded by construction.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from steward.plans.bindings import bind
from steward.session import bound_batches, ship_package

_WORKBOOK_XML = (
    '<workbook xmlns:r="r"><sheets><sheet name="Orders" sheetId="1" r:id="rId1"/></sheets></workbook>'
)
_RELS_XML = (
    '<Relationships><Relationship Id="rId1" Type="http://x/worksheet" '
    'Target="worksheets/sheet1.xml"/></Relationships>'
)
_STYLES_XML = (
    '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
)


def yaml_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`manifest_id, content`: well-formed YAML, or one defect by block number."""
    items = bind(spark, sf_dir, "yaml_items").groupBy("g").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(doc_id, item))), x -> x.item), '\\n')")
        .alias("body")
    )
    text = """
        CASE g % 7 WHEN 1 THEN 'version: 1\\nversion: 2\\nsources:\\n' || body
             WHEN 2 THEN '- just\\n- a list\\n' WHEN 3 THEN 'version: [1\\n'
             WHEN 4 THEN 'version: true\\nsources: {a: 1}\\n'
             ELSE 'version: 1\\nsources:\\n' || body END
    """
    content = f"concat(encode({text}, 'UTF-8'), IF(g % 7 = 5, unhex('FF'), unhex('')))"
    return items.selectExpr("'Y-' || g AS manifest_id", f"{content} AS content")


def _packed(sheet: str, extra: tuple[str, ...] = ()) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("[Content_Types].xml", "<Types/>")
        archive.writestr("xl/workbook.xml", _WORKBOOK_XML)
        archive.writestr("xl/_rels/workbook.xml.rels", _RELS_XML)
        archive.writestr("xl/styles.xml", _STYLES_XML)
        archive.writestr("xl/worksheets/sheet1.xml", sheet)
        for name in extra:
            archive.writestr(name, "<x/>")
    return buffer.getvalue()


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"workbook_id": batch["workbook_id"], "content": [_packed(sheet) for sheet in batch["sheet"]]})


#: Faults of a workbook by its number modulo 11: entries beside the usual ones.
EXTRA_ENTRIES = {2: ("xl/vbaProject.bin",), 4: ("customXml/item1.xml",), 5: ("xl/embeddings/a.bin", "xl/activeX/a.xml"), 6: ("../evil.xml",)}


def _pack_faulty(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        contents = []
        for workbook_id, sheet in zip(batch["workbook_id"], batch["sheet"], strict=True):
            fault = int(workbook_id.removeprefix("XW-")) % 11
            if fault == 1:
                contents.append(sheet.encode()[:200])
            elif fault == 3:
                contents.append(_packed(sheet[: len(sheet) // 2]))
            else:
                contents.append(_packed(sheet, EXTRA_ENTRIES.get(fault, ())))
        yield pd.DataFrame({"workbook_id": batch["workbook_id"], "content": contents})


def order_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`workbook_id, content`: XLSX bytes of a hundred orders each.

    Row k % 59 = 0 is left out of the file, row k % 53 = 0 is there without cells.
    """
    ship_package(spark)
    bound_batches(spark)
    return _order_sheets(spark, sf_dir).mapInPandas(_pack, "workbook_id string, content binary")


def faulty_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same workbooks, some damaged or with entries that must not be there."""
    ship_package(spark)
    bound_batches(spark)
    return _order_sheets(spark, sf_dir).mapInPandas(_pack_faulty, "workbook_id string, content binary")


def _order_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = """
        CASE kind WHEN 'f' THEN '<c r="C' || r || '"><f>SUM(1,2)</f><v>3</v></c>'
                  WHEN 'e' THEN '<c r="C' || r || '" t="e"><v>#DIV/0!</v></c>'
                  WHEN 'b' THEN '<c r="C' || r || '" t="b"><v>1</v></c>'
                  ELSE '<c r="C' || r || '"><v>' || amount || '</v></c>' END
    """
    row = f"""
        CASE WHEN k % 53 = 0 THEN '<row r="' || r || '"/>' ELSE
          '<row r="' || r || '"><c r="A' || r || '"><v>' || k || '</v></c><c r="B' || r
          || '" t="str"><v>' || status || '</v></c>' || {amount}
          || '<c r="D' || r || '" s="1"><v>' || datediff(day, DATE '1899-12-30') || '</v></c>'
          || IF(k % 13 = 0, '', '<c r="E' || r || '" t="inlineStr"><is><t>' || priority || '</t></is></c>')
          || '</row>' END
    """
    header = '<row r="1"><c r="A1" t="inlineStr"><is><t>Key</t></is></c></row>'
    rows = bind(spark, sf_dir, "order_cells").filter("k % 59 <> 0").selectExpr(
        "workbook_id", "r", f"{row} AS xml"
    )
    return rows.groupBy("workbook_id").agg(
        F.expr(
            f"""'<worksheet><dimension ref="A1:E101"/><sheetData>{header}'
            || array_join(transform(array_sort(collect_list(struct(r, xml))), x -> x.xml), '')
            || '</sheetData></worksheet>'"""
        ).alias("sheet")
    )


def page_workbook_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`workbook_id, entry_name, text, skipped`: XML parts of workbooks with up to twelve sheets."""
    sheets = bind(spark, sf_dir, "book_sheets")
    tag = """'<sheet name="' || sheet_name || '" sheetId="' || (sheet_ordinal + 1) || '"'
             || IF(state = 'visible', '', ' state="' || state || '"')
             || ' r:id="rId' || sheet_ordinal || '"/>'"""
    link = """'<Relationship Id="rId' || sheet_ordinal || '" Type="http://x/worksheet" Target="'
              || IF(sheet_ordinal % 2 = 0, '/xl/', '') || 'worksheets/sheet' || sheet_ordinal || '.xml"/>'"""
    ordered = "array_join(transform(array_sort(collect_list(struct(sheet_ordinal, {0} AS x))), s -> s.x), '')"
    books = sheets.groupBy("workbook_id").agg(
        F.expr("'<workbook><sheets>' || " + ordered.format(tag)
               + " || '</sheets><definedName/><definedName/></workbook>'").alias("book"),
        F.expr("'<Relationships>' || " + ordered.format(link) + " || '</Relationships>'").alias("rels"),
    ).selectExpr(
        "workbook_id",
        "stack(2, 'xl/workbook.xml', book, 'xl/_rels/workbook.xml.rels', rels) AS (entry_name, text)",
    )
    bodies = bind(spark, sf_dir, "sheet_xml").select("workbook_id", "entry_name", "text")
    comments = sheets.filter("commented").selectExpr(
        "workbook_id", "'xl/worksheets/_rels/sheet' || sheet_ordinal || '.xml.rels' AS entry_name",
        """'<Relationships><Relationship Id="a" Type="http://x/comments" Target="c"/></Relationships>' AS text""",
    )
    return books.unionByName(bodies).unionByName(comments).withColumn("skipped", F.lit(False))
