"""XLSX containers: entries, part texts and the cell grid.

A workbook is the unit of work: its zip is opened where its bytes are, and every sheet is parsed once, as a stream that
gives grid rows and structural counts. Rows wait on the task's own disk until the workbook has been read to its end, so a
damaged one leaves a finding and no rows. Shared strings beyond STRING_BYTES stay on that disk as well. Formulas are
never evaluated and nothing is followed or executed.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import lzma
import re
import struct
import tempfile
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from steward.schemas import ERROR, HEADER_SCAN_DEPTH
from steward.session import bound_batches, ship_package
from steward.sources.grid import ROW, cells_of
from steward.staging import staged

_PARTS = (
    "workbook_id string, entry_ordinal bigint, entry_name string, compress_size bigint, "
    "file_size bigint, flag_bits int, text string, counts array<struct<name:string,n:bigint>>, "
    "skipped boolean, readable boolean"
)
_PARTS_COLUMNS = ("workbook_id", "entry_ordinal", "entry_name", "compress_size", "file_size", "flag_bits", "text",
                  "counts", "skipped", "readable")
_CELL = pa.struct([
    ("raw_type", pa.string()), ("date_format", pa.bool_()), ("value_string", pa.string()), ("value_number", pa.float64()),
    ("value_boolean", pa.bool_()), ("value_timestamp", pa.timestamp("us", tz="UTC")),
])
_ENTRY = pa.schema([
    ("entry_ordinal", pa.int64()), ("entry_name", pa.string()), ("compress_size", pa.int64()), ("file_size", pa.int64()),
    ("flag_bits", pa.int32()), ("text", pa.string()), ("counts", pa.list_(pa.struct([("name", pa.string()), ("n", pa.int64())]))),
    ("skipped", pa.bool_()),
])
_TAGGED = pa.schema([
    ("kind", pa.string()), ("workbook_id", pa.string()), *_ENTRY, ("sheet_ordinal", pa.int32()), ("row_ordinal", pa.int64()),
    ("cells", pa.list_(_CELL)),
])
PART, ROWS, UNREADABLE, FAILED = "part", "row", "unreadable", "failed"
#: Cells of a batch, and bytes of rows or shared strings kept in memory before they go to the task's disk.
BATCH_CELLS, SPOOL_BYTES, STRING_BYTES = 50_000, 32 << 20, 16 << 20
#: Container entries of a frame that the parts scanner returns.
PART_ROWS = 2_000
#: Bytes of a sheet's XML handed to the parser at a time.
PARSED_BYTES = 16 << 10
#: What a damaged, encrypted or oddly compressed workbook raises.
DAMAGE = (zipfile.BadZipFile, ElementTree.ParseError, zlib.error, lzma.LZMAError, EOFError, OSError, RuntimeError,
          NotImplementedError, KeyError, ValueError, IndexError, TypeError, StopIteration, struct.error)

#: Parts whose text is delivered; they are small by their nature.
WANTED_TEXT = re.compile(
    r"\[Content_Types\]\.xml|xl/workbook\.xml|xl/_rels/workbook\.xml\.rels|docProps/(?:core|app)\.xml"
)
#: Elements of a sheet that are counted, by name.
COUNTED = {
    "mergeCell": "merged_range_count", "hyperlink": "hyperlink_count", "dataValidation": "data_validation_count",
    "tablePart": "table_count", "drawing": "drawing_count", "sheetProtection": "protection_count",
}
HIDDEN = {"row": "hidden_row_count", "col": "hidden_column_count"}
NOTED = {*COUNTED, *HIDDEN, "dimension"}
#: Built-in number format ids that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
EPOCHS = {False: dt.datetime(1899, 12, 30), True: dt.datetime(1904, 1, 1)}


# --- parts ----------------------------------------------------------------------------------------


def events_of(stream) -> Iterator[tuple[str, str, ElementTree.Element]]:
    """Starts of noted elements and ends of rows of a sheet's XML, with local names; what has ended is forgotten, rows included."""
    data = None
    inside = 0
    parser = ElementTree.XMLPullParser(("start", "end"))
    more = True
    while more:
        chunk = stream.read(PARSED_BYTES)
        if chunk:
            parser.feed(chunk)
        else:
            more = False
            parser.close()
        for event, element in parser.read_events():
            tag = _local(element.tag)
            if event == "start":
                if tag == "sheetData":
                    data = element
                elif tag == "row":
                    inside += 1
                if tag in NOTED:
                    yield event, tag, element
            elif tag == "row":
                inside -= 1
                yield event, tag, element
                if data is not None:
                    data.clear()
                elif not inside:
                    element.clear()
            elif not inside and tag not in ("sheetData", "worksheet"):
                element.clear()


class StructureCounts(dict):
    """Structural counts of a sheet, from the starts of its elements."""

    def add(self, tag: str, element: ElementTree.Element) -> None:
        name = COUNTED.get(tag)
        if tag in HIDDEN and element.get("hidden") in ("1", "true"):
            name = HIDDEN[tag]
        if name:
            self[name] = self.get(name, 0) + 1
        if tag == "mergeCell":
            first = re.sub(r"\D", "", element.get("ref", "").split(":")[0])
            if first and int(first) <= HEADER_SCAN_DEPTH:
                self["merged_top_rows"] = self.get("merged_top_rows", 0) + 1
        elif tag == "dimension":
            columns, rows = _extent(element.get("ref", ""))
            self["declared_columns"], self["declared_rows"] = columns or 0, rows or 0


def count_elements(stream) -> dict[str, int]:
    """Structural counts of a sheet's XML, read as a stream; nothing of it is kept."""
    counts = StructureCounts()
    for event, tag, element in events_of(stream):
        if event == "start":
            counts.add(tag, element)
    return counts


def _sheet_parts(archive: zipfile.ZipFile) -> set[str]:
    """Parts that the workbook's relationships name as sheets, wherever they lie."""
    found = set()
    with contextlib.suppress(KeyError):
        for link in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")):
            if link.get("Type", "").endswith("sheet") and link.get("Target"):
                bare = link.get("Target").lstrip("/")
                found.add(bare if bare.startswith("xl/") else f"xl/{bare}")
    return found


def _rels_of(part: str) -> str:
    folder, _, name = part.rpartition("/")
    return f"{folder}/_rels/{name}.rels"


def _entries(archive: zipfile.ZipFile, read_limit: int | None, counted: dict[str, dict], bad: set[str]) -> list[tuple] | None:
    """Entries of a container, None if it cannot be read. Sheets in `counted` or `bad` were parsed before."""
    try:
        sheets = _sheet_parts(archive)
    except ElementTree.ParseError:
        sheets = set()
    except DAMAGE:
        return None
    texts = {_rels_of(s) for s in sheets}
    rows = []
    for ordinal, info in enumerate(archive.infolist()):
        text = counts = None
        name, skipped = info.filename, False
        if (name in sheets or name in texts or WANTED_TEXT.fullmatch(name)) and not info.flag_bits & 1:
            skipped = name in bad or (read_limit is not None and info.file_size > read_limit)
            try:
                if name in sheets and not skipped:
                    counts = counted.get(name)
                    if counts is None:
                        with archive.open(info) as stream:
                            counts = count_elements(stream)
                elif not skipped:
                    text = archive.read(info).decode("utf-8", "ignore")
            except ElementTree.ParseError:
                skipped = True
            except DAMAGE:
                return None
        rows.append((ordinal, name, info.compress_size, info.file_size, info.flag_bits, text,
                     None if counts is None else [{"name": k, "n": v} for k, v in counts.items()], skipped))
    return rows


def _parts_of(workbook_id: str, content: bytes, read_limit: int | None) -> list[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            entries = _entries(archive, read_limit, {}, set())
    except DAMAGE:
        entries = None
    if entries is None:
        return [(workbook_id, 0, None, 0, 0, 0, None, None, False, False)]
    return [(workbook_id, *entry, True) for entry in entries]


def with_counts(parts: DataFrame) -> DataFrame:
    """Parts given as texts, with `counts` of those that are sheets."""
    columns = [c for c in parts.columns if c != "counts"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*columns).schema.fields)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = []
            for name, text in zip(batch["entry_name"], batch["text"], strict=True):
                sheet = text is not None and name.startswith("xl/") and name != "xl/workbook.xml" and not name.endswith(".rels")
                try:
                    counts.append(list(count_elements(io.BytesIO(text.encode())).items()) if sheet else None)
                except ElementTree.ParseError:
                    counts.append(None)
            yield batch.assign(counts=counts)

    ship_package(parts.sparkSession)
    bound_batches(parts.sparkSession)
    return parts.select(*columns).mapInPandas(scan, f"{schema}, counts array<struct<name:string,n:bigint>>")


def scan_workbook_parts(
    files: DataFrame, read_limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """`(parts, findings)`: every container entry, with the text of the small parts profiling reads
    and the structural counts of the sheets, which are read as streams of any size.

    A sheet that is no XML, or a part above an optional `read_limit`, is marked `skipped`, never
    shown as empty.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows, size = [*_PARTS_COLUMNS], [], 0
        for batch in batches:
            for workbook_id, content in zip(batch["workbook_id"], batch["content"], strict=True):
                found = _parts_of(workbook_id, content, read_limit)
                rows += found
                size += sum(len(text or "") for *_, text, _, _, _ in found)
                if len(rows) >= PART_ROWS or size >= SPOOL_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    ship_package(files.sparkSession)
    bound_batches(files.sparkSession)
    scanned = files.select("workbook_id", "content").mapInPandas(scan, _PARTS)
    findings = scanned.filter("NOT readable").select(
        F.col("workbook_id").alias("subject_id"), F.lit(ERROR).alias("severity"),
        F.lit("INVALID_XLSX_CONTAINER").alias("code"), F.lit("$.zipContainer").alias("path"),
    )
    return scanned.filter("readable").drop("readable"), findings


# --- cells ----------------------------------------------------------------------------------------


@lru_cache(maxsize=4096)
def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(element, name: str):
    return (child for child in element if _local(child.tag) == name)


def _text_of(element) -> str:
    """Visible text of a plain or rich string; phonetic hints are not part of it."""
    texts = []
    for child in element:
        if _local(child.tag) == "t":
            texts.append(child.text or "")
        elif _local(child.tag) == "r":
            texts += [t.text or "" for t in _children(child, "t")]
    return "".join(texts)


def shows_date(number_format: str) -> bool:
    """Does the first section of a number format contain date or time letters?"""
    section = number_format.split(";", 1)[0]
    bare = re.sub(r'"[^"]*"|\\.|_.|\[(?!(?:hh?|mm?|ss?)\])[^\]]*\]', "", section, flags=re.I)
    return re.search(r"[dmhys]", bare, re.I) is not None


class SharedStrings:
    """Strings of a workbook by number: their bytes in a file that leaves memory when it grows, and where each begins."""

    def __init__(self, stream=None):
        self.file = tempfile.SpooledTemporaryFile(max_size=STRING_BYTES)
        self.starts = array("q", [0])
        root = None
        for event, element in ElementTree.iterparse(stream, events=("start", "end")) if stream is not None else ():
            if root is None:
                root = element
            elif event == "end" and _local(element.tag) == "si":
                self.file.write(_text_of(element).encode("utf-8", "surrogatepass"))
                self.starts.append(self.file.tell())
                root.clear()

    def __getitem__(self, number: int) -> str:
        if not 0 <= number < len(self.starts) - 1:
            raise IndexError(number)
        self.file.seek(self.starts[number])
        return self.file.read(self.starts[number + 1] - self.starts[number]).decode("utf-8", "surrogatepass")


class _Workbook:
    """Shared strings, date styles and worksheet parts of one opened container."""

    def __init__(self, archive: zipfile.ZipFile):
        self.archive = archive
        self.names = set(archive.namelist())
        rels = {
            e.get("Id"): (e.get("Target", ""), e.get("Type", ""))
            for e in self._tree("xl/_rels/workbook.xml.rels")
        }
        book = self._tree("xl/workbook.xml")
        self.epoch = EPOCHS[
            any(e.get("date1904") in ("1", "true") for e in _children(book, "workbookPr"))
        ]
        self.sheets = []
        for sheets in _children(book, "sheets"):
            for sheet in _children(sheets, "sheet"):
                rid = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
                target, kind = rels[rid]
                if kind.endswith("/worksheet"):
                    part = target.lstrip("/")
                    self.sheets.append(part if part.startswith("xl/") else f"xl/{part}")
        self.strings = SharedStrings()
        if "xl/sharedStrings.xml" in self.names:
            with archive.open("xl/sharedStrings.xml") as stream:
                self.strings = SharedStrings(stream)
        self.date_styles = self._date_styles()

    def _tree(self, name: str):
        return ElementTree.fromstring(self.archive.read(name))

    def _date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.names:
            return set()
        styles = self._tree("xl/styles.xml")
        custom = {
            int(f.get("numFmtId")): f.get("formatCode", "")
            for group in _children(styles, "numFmts") for f in group
        }
        formats = [
            int(xf.get("numFmtId", "0")) for group in _children(styles, "cellXfs") for xf in group
        ]
        return {
            i for i, f in enumerate(formats)
            if (shows_date(custom[f]) if f in custom else f in DATE_FORMATS)
        }

    def moment(self, serial: float) -> dt.datetime:
        days = serial
        if self.epoch == EPOCHS[False] and 0 < serial < 60:
            days += 1
        return self.epoch + dt.timedelta(milliseconds=round(days * 86_400_000))

    def cell(self, element) -> tuple:
        """`(raw_type, date_format, string, number, boolean, timestamp)` of one `<c>`."""
        kind = element.get("t", "n")
        inline = value = None
        for child in element:
            name = _local(child.tag)
            if name == "f":
                return "f", False, "=" + (child.text or ""), None, None, None
            if name == "v":
                value = value or child.text
            elif name == "is" and inline is None:
                inline = child
        if kind == "inlineStr":
            text = _text_of(inline) if inline is not None else None
            return "inlineStr", False, text, None, None, None
        if not value:
            return kind, False, None, None, None, None
        if kind == "s":
            return "s", False, self.strings[int(value)], None, None, None
        if kind == "b":
            return "b", False, None, None, value.strip() != "0", None
        if kind == "d":
            moment = dt.datetime.fromisoformat(value.replace("Z", ""))
            return "d", True, None, None, None, moment
        if kind == "n":
            number = float(value)
            if int(element.get("s", "0")) in self.date_styles:
                try:
                    return "d", True, None, None, None, self.moment(number)
                except OverflowError:
                    return "e", False, "#VALUE!", None, None, None
            if re.fullmatch(r"-?\d+", value) and int(value) != number:  # a double would round it
                return "n", False, value, None, None, None
            return "n", False, None, number, None, None
        return kind, False, value, None, None, None

    def rows(self, stream, max_rows: int | None, max_columns: int | None, counts: StructureCounts) -> Iterator[tuple[int, list[tuple]]]:
        """`(row, cells)` of the dense grid within the declared size and the budget; `counts` fills up on the way.

        Rows and cells the file leaves out are blank; rows after its last one do not exist.
        """
        width, height, current = None, None, 0
        row_at = 0
        for event, tag, element in events_of(stream):
            if event == "start":
                counts.add(tag, element)
                if tag == "dimension":
                    width, height = _extent(element.get("ref", ""))
            else:
                row_at, cells = int(element.get("r") or row_at + 1), {}
                for cell in element.iter():
                    if _local(cell.tag) == "c":
                        reference = cell.get("r")
                        column = _column(reference) if reference else max(cells, default=0) + 1
                        if max_columns is None or column <= max_columns:
                            cells[column] = self.cell(cell)
                limit = min(x for x in (height, max_rows, row_at) if x is not None)
                columns = min(x for x in (width, max_columns) if x is not None) if width else (
                    max_columns or max(cells, default=0))
                for missing in range(current + 1, min(row_at, limit + 1)):
                    yield missing, [_BLANK] * columns
                if current < row_at <= limit:
                    yield row_at, [cells.get(column, _BLANK) for column in range(1, columns + 1)]
                current = max(current, row_at)


_BLANK = ("n", False, None, None, None, None)


def _column(reference: str) -> int:
    return _letters(reference.rstrip("0123456789"))


@lru_cache(maxsize=4096)
def _letters(reference: str) -> int:
    number = 0
    for letter in reference:
        if not letter.isalpha():
            break
        number = number * 26 + ord(letter.upper()) - 64
    return number


def _extent(reference: str) -> tuple[int | None, int | None]:
    last = reference.rsplit(":", 1)[-1]
    digits = re.sub(r"\D", "", last)
    return (_column(last), int(digits)) if digits else (None, None)


class _Spool:
    """Grid rows of a workbook as record batches, in a file that leaves memory when it grows."""

    def __init__(self, workbook_id: str):
        self.workbook_id = workbook_id
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
        self.writer = pa.ipc.new_stream(pa.PythonFile(self.file, "w"), _TAGGED)
        self.keys: list[tuple[int, int, int]] = []
        self.cells: list[tuple] = []

    def add(self, sheet: int, row: int, cells: list[tuple]) -> None:
        self.keys.append((sheet, row, len(cells)))
        self.cells += cells
        if len(self.cells) >= BATCH_CELLS:
            self.flush()

    def flush(self) -> None:
        if not self.keys:
            return
        sheet, row, size = zip(*self.keys, strict=True)
        fields = list(zip(*self.cells, strict=True)) or [()] * len(_CELL)
        flat = pa.StructArray.from_arrays([pa.array(list(v), f.type) for v, f in zip(fields, _CELL, strict=True)], fields=list(_CELL))
        ends = [0]
        for n in size:
            ends.append(ends[-1] + n)
        cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        self.writer.write_batch(_tagged(ROWS, self.workbook_id, len(sheet), sheet_ordinal=list(sheet), row_ordinal=list(row), cells=cells))
        self.keys, self.cells = [], []

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.flush()
        self.writer.close()
        self.file.seek(0)
        yield from pa.ipc.open_stream(pa.PythonFile(self.file, "r"))


def _tagged(kind: str, workbook_id: str, n: int, **columns) -> pa.RecordBatch:
    """Rows of the tagged table; columns that the kind doesn't have are null."""
    filled = {"kind": [kind] * n, "workbook_id": [workbook_id] * n, **columns}
    arrays = []
    for field in _TAGGED:
        values = filled.get(field.name)
        arrays.append(pa.nulls(n, field.type) if values is None else values if isinstance(values, pa.Array) else pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_TAGGED)


def _scanned(workbook_id: str, content: bytes, max_rows: int | None, max_columns: int | None, read_limit: int | None) -> Iterator[pa.RecordBatch]:
    """Entries, grid rows and failures of a workbook, each part read once."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except DAMAGE:
        yield _tagged(UNREADABLE, workbook_id, 1)
        yield _tagged(FAILED, workbook_id, 1)
        return
    with archive:
        spool, counted, bad = _Spool(workbook_id), {}, set()
        try:
            workbook = _Workbook(archive)
        except DAMAGE:
            workbook = None
        loaded = workbook is not None
        for ordinal, part in enumerate(workbook.sheets if loaded else ()):
            counts = StructureCounts()
            try:
                with archive.open(part) as stream:
                    for row, cells in workbook.rows(stream, max_rows, max_columns, counts):
                        if loaded:
                            spool.add(ordinal, row, cells)
                counted[part] = counts
            except ElementTree.ParseError:
                loaded = False
                bad.add(part)
            except DAMAGE:
                loaded = False
        entries = _entries(archive, read_limit, counted, bad)
        if entries is None:
            yield _tagged(UNREADABLE, workbook_id, 1)
        elif entries:
            yield _tagged(PART, workbook_id, len(entries), **dict(zip(_ENTRY.names, map(list, zip(*entries, strict=True)), strict=True)))
        if loaded:
            yield from spool.batches()
        else:
            yield _tagged(FAILED, workbook_id, 1)


@dataclass(frozen=True)
class Workbooks:
    """What one reading of the files gave: entries, grid rows with raw cells, and two kinds of findings."""

    parts: DataFrame
    rows: DataFrame
    container_findings: DataFrame
    load_findings: DataFrame

    def cells(self, fold_inline: bool = False) -> DataFrame:
        """The grid cell by cell, classified."""
        return cells_of(self.rows, fold_inline)


def scan_workbooks(
    files: DataFrame, max_rows: int | None = None, max_columns: int | None = None, read_limit: int | None = None
) -> Workbooks:
    """Entries, structural counts and grid rows of every workbook in `files` (workbook_id, content).

    The scan is written once, tagged by kind, and every output reads that table. A workbook that
    cannot be loaded has a finding and no rows; one whose container cannot be read has no parts either.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for workbook_id, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from _scanned(workbook_id.as_py(), content.as_py() or b"", max_rows, max_columns, read_limit)

    ship_package(files.sparkSession)
    bound_batches(files.sparkSession)
    entry = ("entry_ordinal bigint, entry_name string, compress_size bigint, file_size bigint, flag_bits int, text string, "
             "counts array<struct<name:string,n:bigint>>, skipped boolean")
    cell = "raw_type:string,date_format:boolean,value_string:string,value_number:double,value_boolean:boolean,value_timestamp:timestamp"
    schema = f"kind string, workbook_id string, {entry}, sheet_ordinal int, row_ordinal bigint, cells array<struct<{cell}>>"
    tagged = staged(files.select("workbook_id", "content").mapInArrow(scan, schema), "workbooks")

    def finding(kind: str, code: str, *path) -> DataFrame:
        return tagged.filter(F.col("kind") == kind).select(
            F.col("workbook_id").alias("subject_id"), F.lit(ERROR).alias("severity"), F.lit(code).alias("code"), *path)

    return Workbooks(
        tagged.filter(F.col("kind") == PART).select("workbook_id", *_ENTRY.names),
        tagged.filter(F.col("kind") == ROWS).select(*ROW, "cells"),
        finding(UNREADABLE, "INVALID_XLSX_CONTAINER", F.lit("$.zipContainer").alias("path")),
        finding(FAILED, "WORKBOOK_LOAD_FAILED"),
    )


def scan_workbook_cells(
    files: DataFrame, max_rows: int | None = None, max_columns: int | None = None,
    fold_inline: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """`(cells, findings)`: the dense grid of every worksheet of every workbook, cell by cell."""
    scanned = scan_workbooks(files, max_rows, max_columns)
    return scanned.cells(fold_inline), scanned.load_findings
