"""Delimited files and workbooks: encodings, quoted line ends, sheets and the way back."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodemap.sources import files, workbooks


def raw(spark, folder, content, name="a.csv"):
    (folder / name).write_bytes(content)
    df = files.read_raw(spark, str(folder / name))
    return [tuple(r)[1:] for r in df.orderBy("_row_id").collect()]


@pytest.mark.parametrize(
    ("content", "rows"),
    [
        (b"a;b\n1;2\n", [("a", "b"), ("1", "2")]),
        ("é,b\n1,ü\n".encode("cp1252"), [("é", "b"), ("1", "ü")]),
        ("é,b\n1,ü\n".encode(), [("é", "b"), ("1", "ü")]),
        ("é,b\n1,ü\n".encode("utf-16"), [("é", "b"), ("1", "ü")]),
        ("“é”;€\n1;2\n".encode("cp1252"), [("“é”", "€"), ("1", "2")]),
        (b'"a,b",c\n1,2\n', [("a,b", "c"), ("1", "2")]),
        (b'x,y,"a\nb",z,w\n1\n', [("x", "y", "a\nb", "z", "w"), ("1", None, None, None, None)]),
        (b'5" pipe,6" pipe,x\n1,2,3\n', [('5" pipe', '6" pipe', "x"), ("1", "2", "3")]),
    ],
)
def test_delimited_files(spark, tmp_path, content, rows):
    assert raw(spark, tmp_path, content) == rows


def test_workbooks_there_and_back(spark, tmp_path):
    rows = [(1, 2.5, True, "a <&> \x01b\r\n c", None), (2**40, -0.25, False, "", "x"), (3, float("nan"), None, " é ", "y")]
    df = spark.createDataFrame(rows, "k long, v double, b boolean, `a b` string, n string").coalesce(1)
    made = workbooks.as_workbooks(df, rows_each=2)
    assert sorted(r["n_rows"] for r in made.collect()) == [1, 2]
    one = workbooks.as_workbooks(df).first()
    (tmp_path / "w.xlsx").write_bytes(one["content"])
    found = workbooks.read_workbooks(spark, str(tmp_path / "w.xlsx"))
    table = workbooks.sheet_table(found, found.first()["path"], "Sheet1").orderBy("_row_id").collect()
    assert [tuple(r)[1:] for r in table] == [
        ("k", "v", "b", "a b", "n"),
        ("1", "2.5", "TRUE", "a <&> b\r\n c", None),
        (str(2**40), "-0.25", "FALSE", None, "x"),
        ("3", None, None, " é ", "y"),
    ]
    assert workbooks.as_workbooks(df.limit(0)).count() == 0
    with pytest.raises(files.UnsupportedFile):
        workbooks.read_workbooks(spark, "a.xls")


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def test_shared_strings_dates_blank_rows_and_sheets(spark):
    main, rels = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = archive({
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rels}"><sheets><sheet name="S" r:id="a"/><sheet name="Empty" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>Title</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/s1.xml": f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c>'
        '<c r="D3" s="1"><v>45292.5</v></c><c r="E3" t="b"><v>1</v></c><c r="F3" t="e"><v>#N/A</v></c></row><row r="9"/></sheetData></worksheet>',
        "xl/worksheets/s2.xml": f"<worksheet {main}><sheetData/></worksheet>",
    })
    office = "urn:oasis:names:tc:opendocument:xmlns:"
    ods = archive({
        "content.xml": f'<d xmlns:table="{office}table:1.0" xmlns:office="{office}office:1.0" xmlns:text="{office}text:1.0"><table:table table:name="T">'
        '<table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="float" office:value="12.0"/>'
        '<table:table-cell table:number-columns-repeated="2"/><table:table-cell office:value-type="string"><text:p>x</text:p><text:p>y</text:p></table:table-cell>'
        '<table:table-cell table:number-columns-repeated="1000"/></table:table-row><table:table-row table:number-rows-repeated="90000"><table:table-cell/></table:table-row></table:table></d>'
    })
    df = spark.createDataFrame([("b", book), ("o", ods)], "path string, content binary")
    got = [(r["path"], r["sheet"], r["row_no"], r["cells"]) for r in workbooks.sheet_rows(df).orderBy("path", "row_no").collect()]
    assert got == [
        ("b", "S", 0, ["Title"]), ("b", "S", 1, []), ("b", "S", 2, [None, "two runs", None, "2024-01-01T12:00:00", "TRUE", None]),
        ("o", "T", 0, ["12", None, None, "x\ny"]), ("o", "T", 1, ["12", None, None, "x\ny"]),
    ]
    with pytest.raises(Exception, match="UnsupportedFile"):
        workbooks.sheet_rows(df.select("path", F.lit(b"no zip").alias("content"))).collect()


def test_texts_are_one_page_a_file(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\n\nTwo\nThree\n")
    (tmp_path / "b.txt").write_text(" \n")
    got = {r["path"].rpartition("/")[2]: (r["text"], r["confidence"], r["reason"]) for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("# One\n\nTwo\nThree\n", 0.98, None), "b.txt": (" \n", 0.2, "empty_document")}
