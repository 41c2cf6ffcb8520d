"""Page source, rule checks and cleaners, and the toolbox."""

import pytest
from pyspark.sql import functions as F

from lodemap.operators import retrieve, rules
from lodemap.operators.toolbox import Toolbox, number
from lodemap.sources.pages import PageSource


@pytest.fixture(scope="module")
def pages(spark):
    spark.dataSource.register(PageSource)
    return lambda path, **options: spark.read.format("document_pages").options(**options).load(str(path))


def test_pages_of_text_files(pages, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("﻿# One\r\n\fTwo\f ".encode())
    (tmp_path / "sub" / "b.TXT").write_bytes(b"caf\xe9")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    df = pages(f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() == 3
    got = sorted((r["path"].rsplit("/", 1)[1], r["page"], r["text"], r["confidence"]) for r in df.collect())
    assert got == [("a.md", 1, "# One\n", 0.98), ("a.md", 2, "Two", 0.98), ("a.md", 3, " ", 0.2), ("b.TXT", 1, "caf�", 0.98), ("empty.txt", 1, "", 0.2)]
    assert pages(tmp_path / "a.md").where("page = 2").select("text").first()[0] == "Two"


def halves(content):
    """An extractor of two pages."""
    half = len(content) // 2
    return [content[:half].decode(), content[half:].decode()]


def test_extractors_are_named_and_needed(pages, tmp_path):
    (tmp_path / "c.pdf").write_bytes(b"leftright!")
    with pytest.raises(Exception, match="NoExtractor"):
        pages(tmp_path).collect()
    got = pages(tmp_path, **{"extractor.pdf": "tests.test_plugins:halves"}).orderBy("page").collect()
    assert [r["text"] for r in got] == ["leftr", "ight!"]
    with pytest.raises(Exception, match="TooManyPages"):
        pages(tmp_path, maxPages=1, **{"extractor.pdf": "tests.test_plugins:halves"}).collect()
    (tmp_path / "d.exe").write_bytes(b"x")
    with pytest.raises(Exception, match="UnsupportedFile"):
        pages(tmp_path, **{"extractor.pdf": "tests.test_plugins:halves"}).collect()


def test_modules_clean_and_check(spark):
    modules = rules.Modules()
    df = spark.createDataFrame([(1, "  a ", 5.0), (2, None, -1.0), (3, "c", None)], "id long, name string, x double")
    assert modules.cleaned(df) is df and modules.checked(df).count() == 0
    modules.register(rules.Module("trim", cleaners=(lambda r: {**r, "name": r["name"] and r["name"].strip()}, lambda r: {**r, "x": None if r["x"] is None else r["x"] * 2})))
    modules.register(rules.Module("bounds", checks=(rules.within("x", 0, 8), rules.needed("name"), rules.in_order("id", "x"))))
    for name in ("bounds", " bounds ", " "):
        with pytest.raises(ValueError):
            modules.register(rules.Module(name))
    clean = modules.cleaned(df)
    assert [tuple(r) for r in clean.orderBy("id").collect()] == [(1, "a", 10.0), (2, None, -2.0), (3, "c", None)]
    got = sorted((r["id"], r["module"], r["message"]) for r in modules.checked(clean.withColumn("module_", F.lit(1))).collect())
    assert got == [(1, "bounds", "x is outside 0 to 8"), (2, "bounds", "id is after x"), (2, "bounds", "name is missing"), (2, "bounds", "x is outside 0 to 8")]


def test_toolbox(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, "Late fees apply", True), ("b", 0, "Other", False)], "doc_id string, chunk int, text string, low_confidence boolean")
    index = retrieve.index_chunks(chunks, f"file://{tmp_path}/i")
    sales = spark.createDataFrame([(1, "x"), (2, None), (3, "x")], "id long, kind string")
    box = Toolbox(spark, {"sales": sales}, {"sales": "Sales"}, {"description": "d", "questions": ["q"]}, index)
    listed = box.list_tables()
    assert listed["ok"] and listed["tables"][0]["row_count"] == 3 and listed["tables"][0]["columns"] == ["id", "kind"]
    told = box.describe_table("sales")
    assert told["column_count"] == 2 and [(c["name"], c["dtype"], c["null_rate"]) for c in told["columns"]] == [("id", "bigint", 0.0), ("kind", "string", 0.3333)]
    assert box.describe_table()["error"].startswith("describe_table missing") and box.describe_table("x") == {"ok": False, "error": "Unknown table: x", "available_tables": ["sales"]}
    assert box.read_guide()["guide"] == {"description": "d"} and not Toolbox(spark, {}).read_guide()["ok"]
    hits = box.search_documents(" late fee ", "3")
    assert hits["result_count"] == 2 and hits["chunks"][0]["doc_id"] == "a" and hits["has_low_confidence"]
    assert [box.search_documents(q)["ok"] for q in (None, "  ")] == [False, False] and not Toolbox(spark, {}).search_documents("q")["ok"]
    assert [number(x, 5, 1, 10) for x in (None, "x", True, 0, "7", 99)] == [5, 5, 5, 1, 7, 10]
