"""Encodings by their bytes, and dates in words."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodemap.functions import cells
from lodemap.functions.natural import natural_date
from lodemap.sources import charsets, files

TEXTS = {
    "windows-1252": "Le café était fermé à Noël; der Käse schmeckt süß, señor.",
    "windows-1250": "Zażółć gęślą jaźń. Příliš žluťoučký kůň úpěl.",
    "windows-1251": "Съешь же ещё этих мягких французских булок, да выпей чаю.",
    "koi8-r": "Съешь же ещё этих мягких французских булок, да выпей чаю.",
    "windows-1253": "Το ξύλο βγήκε από τον παράδεισο και η αλήθεια είναι εδώ.",
    "shift_jis": "これは日本語のテキストです。東京で会いましょう。",
    "euc-jp": "これは日本語のテキストです。東京で会いましょう。",
    "gb18030": "这是一个中文的文件，我们在这里说的是经济和国家的发展。",
    "big5": "這是一個中文的文件，我們在這裡說的是經濟和國家的發展。",
    "euc-kr": "이것은 한국어로 된 문서이고 사람들이 그것을 읽는다.",
    "utf-8": "naïve 日本 Ещё",
}


@pytest.mark.parametrize("encoding", sorted(TEXTS))
def test_encodings_are_told_apart(spark, tmp_path, encoding):
    (tmp_path / "t.csv").write_bytes(("plain,line\n" + TEXTS[encoding] + "\n").encode(encoding) * 20)
    found, sure = charsets.detected(spark, f"file://{tmp_path}/t.csv")
    assert found == encoding and sure > 0.2


def test_marks_ascii_and_noise(spark, tmp_path):
    for name, content, wanted in (("a", "x,é".encode("utf-8-sig"), "utf-8"), ("b", "x,é\n".encode("utf-16"), "utf-16"), ("c", b"x,y\n", "utf-8"), ("d", b"", "utf-8"), ("e", bytes(range(128, 256)) + b"\n", "windows-1252")):
        (tmp_path / name).write_bytes(content)
        assert charsets.detected(spark, f"file://{tmp_path}/{name}")[0] == wanted


def test_raw_tables_in_found_encodings(spark, tmp_path):
    for encoding in ("windows-1251", "gb18030", "windows-1252"):
        (tmp_path / f"{encoding}.csv").write_bytes(("name;n\n" + f"{TEXTS[encoding].split('.')[0].split(';')[0]};1\n" * 5).encode(encoding))
        rows = files.read_raw(spark, f"file://{tmp_path}/{encoding}.csv").orderBy("_row_id").collect()
        assert len(rows) == 6 and rows[1]["c0"] == TEXTS[encoding].split(".")[0].split(";")[0]


NOW = datetime.datetime(2024, 3, 31, 10, 30)
DATES = {
    "3 mars 2024": datetime.datetime(2024, 3, 3),
    "March 3rd, 2024 14:05": datetime.datetime(2024, 3, 3, 14, 5),
    "den 3. März 2024": datetime.datetime(2024, 3, 3),
    "1er août 2023": datetime.datetime(2023, 8, 1),
    "15 de marzo de 2024": datetime.datetime(2024, 3, 15),
    "Sunday, 31 December 2023": datetime.datetime(2023, 12, 31),
    "Dec 31 2023": datetime.datetime(2023, 12, 31),
    "31 February 2024": None,
    "today": NOW,
    "Gestern": datetime.datetime(2024, 3, 30, 10, 30),
    "2 weeks ago": datetime.datetime(2024, 3, 17, 10, 30),
    "a month ago": datetime.datetime(2024, 2, 29, 10, 30),
    "in 3 Tagen": datetime.datetime(2024, 4, 3, 10, 30),
    "il y a 2 heures": datetime.datetime(2024, 3, 31, 8, 30),
    "hace 10 minutos": datetime.datetime(2024, 3, 31, 10, 20),
    "next year": datetime.datetime(2025, 3, 31, 10, 30),
    "last fortnight": None,
    "open": None,
    "may": None,
    "12": None,
    "3 foo 2024": None,
    "": None,
    None: None,
}


def test_dates_in_words(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", natural_date(F.col("t"), F.lit(NOW)).alias("d")).collect()}
    assert got == DATES


def test_columns_of_dates_in_words(spark):
    df = spark.createDataFrame([("3 mars 2024", "open"), ("4 avril 2024", "3 mars 2024"), ("5 mai 2024", "x")], "a string, b string")
    found = cells.votes(df)
    assert (found["a"].kind, found["a"].layout, found["b"].kind) == ("datetime", cells.NATURAL, "string")
    cast = cells.cast_columns(df, {"a": "date"}, found).orderBy("a").collect()
    assert [r["a"] for r in cast] == [datetime.date(2024, 3, 3), datetime.date(2024, 4, 4), datetime.date(2024, 5, 5)]
