"""Workbooks (xlsx, xlsm, ods) to rows and back.

A workbook is one row of ``binaryFile``; its sheets are parsed as a stream inside
the task, so a task holds one file, its shared strings and one batch of rows. Cells
are text as ``as_text`` gives it: whole numbers without fraction, TRUE and FALSE,
dates in ISO form, errors and empty cells null.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import EmptyFile, UnsupportedFile

SUFFIXES, BINARY_SUFFIXES = (".xlsx", ".xlsm", ".ods"), (".xls", ".xlsb")
BATCH = 2_000
#: Rows of a sheet that the format allows, the header included.
MOST_ROWS = 1_048_576
# Number formats of the OOXML standard that show dates or times.
DATE_STYLES = {*range(14, 23), 45, 46, 47}
ROWS = "path string, sheet string, sheet_no int, row_no long, cells array<string>"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ODS = {"table": "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}", "office": "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"}


def _name(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _shown(number: float) -> str:
    return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)


def _column(reference: str) -> int:
    """0-based column of a cell reference such as AB12."""
    at = 0
    for sign in reference:
        if not sign.isalpha():
            break
        at = 26 * at + ord(sign.upper()) - 64
    return at - 1


def _moment(serial: float, base_1904: bool) -> str:
    start = datetime.datetime(1904, 1, 1) if base_1904 else datetime.datetime(1899, 12, 30)
    return (start + datetime.timedelta(seconds=round(serial * 86_400))).isoformat()


def _text(node: ElementTree.Element) -> str:
    """Text of a shared or inline string: its runs, without phonetic hints."""
    if _name(node) == "rPh":
        return ""
    return (node.text or "" if _name(node) == "t" else "") + "".join(_text(child) for child in node)


def _xlsx(book: zipfile.ZipFile) -> Iterator[tuple[str, Iterator[list]]]:
    def part(name: str) -> ElementTree.Element | None:
        return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None

    strings, styles = [], part("xl/styles.xml")
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            for _, node in ElementTree.iterparse(f):
                if _name(node) == "si":
                    strings.append(_text(node))
                    node.clear()
    dated: list[bool] = []
    if styles is not None:
        formats = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter() if _name(n) == "numFmt"}
        for group in (n for n in styles if _name(n) == "cellXfs"):
            for xf in group:
                at = int(xf.get("numFmtId", 0))
                bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", formats.get(at, "")).lower()
                dated.append(at in DATE_STYLES or (bare != "general" and bool(re.search("[ymdhs]", bare))))
    workbook = part("xl/workbook.xml")
    base_1904 = any(_name(n) == "workbookPr" and n.get("date1904") in ("1", "true") for n in workbook)
    targets = {n.get("Id"): n.get("Target") for n in part("xl/_rels/workbook.xml.rels")}

    def value(cell: ElementTree.Element) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return "".join(_text(n) for n in cell if _name(n) == "is") or None
        raw = next((n.text for n in cell if _name(n) == "v"), None)
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return strings[int(raw)] or None
        if kind == "b":
            return "TRUE" if raw == "1" else "FALSE"
        if kind != "n":
            return raw or None
        style = int(cell.get("s", 0))
        return _moment(float(raw), base_1904) if style < len(dated) and dated[style] else _shown(float(raw))

    def rows(target: str) -> Iterator[list]:
        done = 0
        with book.open(target) as f:
            for _, node in ElementTree.iterparse(f):
                if _name(node) != "row":
                    continue
                at = int(node.get("r", done + 1)) - 1
                yield from ([] for _ in range(at - done))
                cells: list[str | None] = []
                for cell in node:
                    column = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [None] * (column + 1 - len(cells))
                    cells[column] = value(cell)
                yield cells
                done = at + 1
                node.clear()

    for sheet in (n for n in workbook.iter() if _name(n) == "sheet"):
        target = targets[sheet.get(REL)]
        target = target[1:] if target.startswith("/") else f"xl/{target}"
        if target.startswith("xl/worksheets/"):
            yield sheet.get("name"), rows(target)


def _ods(book: zipfile.ZipFile) -> Iterator[tuple[str, Iterator[list]]]:
    table, office = ODS["table"], ODS["office"]

    def value(cell: ElementTree.Element) -> str | None:
        kind = cell.get(office + "value-type")
        if kind in ("float", "currency", "percentage"):
            return _shown(float(cell.get(office + "value")))
        if kind == "boolean":
            return cell.get(office + "boolean-value", "").upper()
        if kind == "date":
            moment = cell.get(office + "date-value")
            return moment if "T" in moment else moment + "T00:00:00"
        return "\n".join("".join(p.itertext()) for p in cell if _name(p) == "p") or None

    def rows(node: ElementTree.Element) -> Iterator[list]:
        for row in node.iter(table + "table-row"):
            cells: list[str | None] = []
            blanks = 0
            for cell in row:
                if _name(cell) not in ("table-cell", "covered-table-cell"):
                    continue
                found, times = value(cell), int(cell.get(table + "number-columns-repeated", 1))
                if found is None:
                    blanks += times
                else:
                    cells += [None] * blanks + [found] * times
                    blanks = 0
            yield from (cells for _ in range(int(row.get(table + "number-rows-repeated", 1))))

    with book.open("content.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == table + "table":
                yield node.get(table + "name"), rows(node)
                node.clear()


def _numbered(rows: Iterator[list]) -> Iterator[tuple[int, list]]:
    """Rows with their place in the sheet; blank ones only where a row with cells follows."""
    blank = 0
    for at, cells in enumerate(rows):
        if all(c is None for c in cells):
            blank += 1
            continue
        yield from ((k, []) for k in range(at - blank, at))
        blank = 0
        yield at, cells


def sheet_rows(found: DataFrame) -> DataFrame:
    """(path, sheet, sheet_no, row_no, cells) of workbooks given as (path, content).

    Sheets without a cell give no row; a file that is no workbook raises UnsupportedFile.
    """
    schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("sheet_no", pa.int32()), ("row_no", pa.int64()), ("cells", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                path = path.as_py()
                try:
                    book = zipfile.ZipFile(io.BytesIO(content.as_py()))
                except zipfile.BadZipFile:
                    raise UnsupportedFile(path) from None
                sheets = _ods(book) if "content.xml" in book.namelist() else _xlsx(book)
                for no, (sheet, rows) in enumerate(sheets):
                    numbered = _numbered(rows)
                    while part := list(islice(numbered, BATCH)):
                        n = len(part)
                        columns = [[path] * n, [sheet] * n, [no] * n, [r[0] for r in part], [r[1] for r in part]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return found.select("path", "content").mapInArrow(run, ROWS)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``sheet_rows`` of the workbooks under a path; a file of another kind raises UnsupportedFile."""
    low = path.lower().rstrip("/")
    if low.endswith(BINARY_SUFFIXES):
        raise UnsupportedFile(path)
    found = spark.read.format("binaryFile").load(path)
    return sheet_rows(found if low.endswith(SUFFIXES) else found.where(F.lower("path").rlike(r"\.(xlsx|xlsm|ods)$")))


def sheet_table(rows: DataFrame, path: str, sheet: str) -> DataFrame:
    """(_row_id, c0..cN string) of one sheet, ragged rows filled with null; EmptyFile if it has no cell."""
    one = rows.where((F.col("path") == path) & (F.col("sheet") == sheet))
    width = one.agg(F.max(F.size("cells"))).first()[0]
    if not width:
        raise EmptyFile(f"{path}: {sheet}")
    return one.select(F.col("row_no").alias("_row_id"), *[F.get("cells", F.lit(k)).alias(f"c{k}") for k in range(width)])


# The least parts of a workbook with one sheet.
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
)
_RELATION = (
    '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/></Relationships>'
)
_BOOK = (
    '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>'
)
_SHEET = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _cell(value: object) -> str:
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    text = str(value).upper() if isinstance(value, bool) else value.isoformat() if isinstance(value, datetime.date) else str(value)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", text), {chr(13): "&#13;"})}</t></is></c>'


def _workbook(sheet: str, header: list[str], rows: list[tuple]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as book:
        book.writestr("[Content_Types].xml", _TYPES)
        book.writestr("_rels/.rels", _RELATION.format(kind="officeDocument", target="xl/workbook.xml"))
        book.writestr("xl/workbook.xml", _BOOK.format(sheet=escape(sheet[:31], {'"': "&quot;"})))
        book.writestr("xl/_rels/workbook.xml.rels", _RELATION.format(kind="worksheet", target="worksheets/sheet1.xml"))
        with book.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(_SHEET.encode())
            for row in (header, *rows):
                f.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def as_workbooks(df: DataFrame, sheet: str = "Sheet1", rows_each: int = 50_000) -> DataFrame:
    """(path, n_rows, content): all rows of ``df`` as xlsx files of at most ``rows_each`` rows, made where the rows are.

    Numbers stay numbers; booleans, dates and all else are text; control signs, which
    the format can't hold, are dropped. No rows give no file.
    """
    if not 0 < rows_each < MOST_ROWS:
        raise ValueError(f"rows_each: {rows_each}")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        part = TaskContext.get().partitionId()
        for no, some in enumerate(iter(lambda: list(islice(rows, rows_each)), [])):
            yield pa.RecordBatch.from_pylist([{"path": f"part-{part:05d}-{no:04d}.xlsx", "n_rows": len(some), "content": _workbook(sheet, names, some)}])

    return df.mapInArrow(run, "path string, n_rows long, content binary")
