"""Exports, durations, shared values of candidates and quotas on fixtures."""

import datetime
from pathlib import Path

from pyspark.sql import functions as F

from lodemap.functions.natural import after, duration_ms
from lodemap.operators import quotas, relate
from lodemap.sources import files


def test_csv_as_office_programs_read_it(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', 1.5), (2, "a,b\r\nc", None), (3, None, 2.0)], 'id long, `x,y` string, z double')
    files.write_csv(df.coalesce(1), f"file://{tmp_path}/out")
    (part,) = Path(tmp_path / "out").glob("part-*")
    assert part.read_bytes() == '﻿id,"x,y",z\r\n1,"say ""hi""",1.5\r\n2,"a,b\r\nc",\r\n3,,2.0\r\n'.encode()
    files.write_csv(df, f"file://{tmp_path}/more", files=2)
    assert len(list(Path(tmp_path / "more").glob("part-*"))) == 2


def test_durations(spark):
    start = datetime.datetime(2024, 1, 31, 12)
    df = spark.createDataFrame([(s, start, start + datetime.timedelta(milliseconds=m)) for s, m in (("30d", 1500), (" 12H", -5), ("4w", 0), ("x", 1), ("3m", 1), (None, None or 0))], "s string, a timestamp_ntz, b timestamp_ntz")
    got = [tuple(r) for r in df.select(after(F.col("a"), F.col("s")), duration_ms(F.col("a"), F.col("b"))).collect()]
    assert got == [
        (datetime.datetime(2024, 3, 1, 12), 1500), (datetime.datetime(2024, 2, 1), 0), (datetime.datetime(2024, 2, 28, 12), 0), (None, 1), (None, 1), (None, 0),
    ]


def test_shared_values_of_candidates(spark):
    tables = {
        "orders": spark.createDataFrame([(f"C{i % 12:03d}", i) for i in range(40)], "customer_id string, n long"),
        "customers": spark.createDataFrame([(f"C{i:03d}", f"name {i}") for i in range(14)], "id string, name string"),
    }
    found = relate.shared_samples(tables, relate.candidates(tables)).collect()
    row = next(r for r in found if r["col_a"] == "customer_id")
    assert row["col_b"] == "id" and row["samples"] == [f"c{i:03d}" for i in range(10)]


def test_quotas(spark):
    used = spark.createDataFrame([("o", "a", "jobs", 2.0), ("o", "b", "jobs", 1.0), ("o", "a", "storage", 90.0), ("p", "c", "storage", 5.0), ("o", "a", "file_size", 1.0)], "org string, user string, kind string, used double")
    limits = spark.createDataFrame([("o", "a", "jobs", 3.0), ("o", None, "jobs", 3.0), ("o", "a", "storage", 100.0), ("o", None, "file_size", 10.0), ("o", "b", "jobs", 0.0)], "org string, user string, kind string, limit double")
    got = {(r["user"], r["kind"], r["scope"]): (r["used"], r["cap"], r["refused"]) for r in quotas.checks([used], limits, {"storage": 11, "file_size": 10}).collect()}
    assert got == {
        ("a", "jobs", "user"): (2.0, 3.0, False),
        ("a", "jobs", "organization"): (3.0, 3.0, True),
        ("b", "jobs", "user"): (1.0, 0.0, True),
        ("b", "jobs", "organization"): (3.0, 3.0, True),
        ("a", "storage", "user"): (90.0, 100.0, True),
        ("a", "file_size", "organization"): (1.0, 10.0, False),
    }
