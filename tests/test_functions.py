"""Cells, profiles, keys, anomalies, chunks and corrections on small fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodemap.functions import cells, text
from lodemap.operators import anomalies, documents, profile, relate, review, usage, validate
from lodemap.operators.values import value_counts
from lodemap.sources import files


def column(spark, values, kind="string", name="c0"):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")


def cast(spark, values, dtype=None):
    df = column(spark, values)
    vote = cells.votes(df)["c0"]
    return vote, [r[0] for r in df.select(cells.cast_cell(F.col("c0"), dtype or vote.kind, vote)).collect()]


def test_numbers(spark):
    assert cast(spark, ["1,23,456", "123,456"])[1] == [123456, 123456]
    vote, values = cast(spark, ["(₹1,234.50)", "Rs 2,000.00", "$3,100.25"])
    assert vote.kind == "float" and values == [-1234.5, 2000.0, 3100.25]
    assert cast(spark, ["1,5", "2,25", "7"])[1] == [1.5, 2.25, 7.0]
    assert cast(spark, ["n/a", " - ", None, "4"])[1] == [None, None, None, 4]


def test_mojibake_and_text(spark):
    rows = column(spark, ["cafÃ©", "MÃ¼nchen", "café", "日本", "Ã"]).select(text.without_mojibake(F.col("c0"))).collect()
    assert [r[0] for r in rows] == ["café", "München", "café", "日本", "Ã"]
    shown = column(spark, ["AB-12 x", "id-000", "2024-01-02"]).select(text.signature(F.col("c0"))).collect()
    assert [r[0] for r in shown] == ["A2-D2 a", "a2-D3", "D4-D2-D2"]
    assert [text.slug_of(x) for x in ("Sales #1", "2024", "--")] == ["sales_1", "t_2024", "table"]
    indian = spark.createDataFrame([(1234567.5,), (123.0,)], "x double").select(text.grouped_number(F.col("x"), True, 1)).collect()
    assert [r[0] for r in indian] == ["12,34,567.5", "123.0"]


def test_dates(spark):
    vote, values = cast(spark, ["13/02/2024", "14/02/2024"])
    assert vote.kind == "datetime" and values[0] == datetime.datetime(2024, 2, 13)
    vote, values = cast(spark, ["01/02/2024", "03/04/2024"])
    assert (vote.kind, vote.confidence, values) == ("string", 0.5, ["01/02/2024", "03/04/2024"])


@pytest.mark.parametrize(("values", "first"), [
    (["2024.02.13", "2024.2.1"], (2024, 2, 13)), (["13.02.24", "14.02.24"], (2024, 2, 13)), (["2/13/69", "3/14/99"], (1969, 2, 13)), (["31-12-68", "30-12-68"], (2068, 12, 31)),
    (["2024/02/13 1:2:3", "2024/02/14 11:22:33"], (2024, 2, 13, 1, 2, 3)), (["13-2-2024 10:00:00", "14-2-2024 10:00:00"], (2024, 2, 13, 10)), (["13 Feb 2024", "1 Mar 2024"], (2024, 2, 13)),
])
def test_date_formats(spark, values, first):
    vote, found = cast(spark, values)
    assert vote.kind == "datetime" and found[0] == datetime.datetime(*first) and None not in found


def test_dates_that_read_both_ways(spark):
    for values in (["01.02.2024", "03.04.2024"], ["1/2/24", "3/4/24"], ["01-02-2024 10:00:00", "2-3-2024 10:00:00"]):
        vote, found = cast(spark, values)
        assert (vote.kind, vote.confidence, vote.reasons, found) == ("string", 0.5, ("ambiguous_date_format",), values)


def test_null_words_and_scale_words(spark):
    nulls = ["", " ", "<NA>", "-nan", "-NaN", "#N/A N/A", "1.#IND", "-1.#QNAN", "#REF!", "nil", "–"]
    kept = [".", "?", "--", "none", "#DIV/0!", "#NAME?", "Nil"]
    assert [r[0] for r in column(spark, nulls + kept).select(cells.clean_cell(F.col("c0"))).collect()] == [None] * len(nulls) + kept
    assert [cells.scale_factor(w) for w in ("Thousands", "lacs", "Crores", "millions", "billions", "1,000", "mn")] == [1e3, 1e5, 1e7, 1e6, 1e9, 1e3, None]


def test_name_likeness():
    wanted = {("customer_id", "id"): 0.85, ("id", "Customer ID"): 0.85, ("order_no", "no"): 0.85, ("a_code", "code"): 8 / 9, ("key", "part_key_key"): 0.85, ("customer_id", "supplier_id"): 0.5, ("x_ref", "ref"): 6 / 7,
              ("Order-ID", "orderid"): 1.0, ("--", "id"): 0.0, ("id", "total"): 0.75, ("amount", "ID"): 0.75, ("c_custkey", "o_custkey"): 0.875}
    assert {k: round(text.similar_names(*k), 6) for k in wanted} == {k: round(v, 6) for k, v in wanted.items()}


def test_six_significant_digits(spark):
    rows = spark.createDataFrame([(0.00001234567,), (1234567.891,), (12345678.0,), (-0.333333333,), (None,)], "x double").select(profile.six_digits(F.col("x"))).collect()
    assert [r[0] for r in rows] == [0.0000123457, 1234570.0, 12345678.0, -0.333333, None]


def test_page_quality(spark):
    clean = "The total amount of this invoice is in the account and the tax is to be paid by the date in this section. " * 2
    even, uneven = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "| a | b |\n| 1 |\n| 1 | 2 | 3 | 4 |\n| 5 | 6 | 7 | 8 | 9 | 10 |"
    df = spark.createDataFrame([(0, clean, False), (1, "[illegible] xq [illegible] zv", False), (2, even, True), (3, uneven, True), (4, None, False)], "i int, t string, tables boolean")
    args = F.col("t"), F.lit(0.9), F.col("tables")
    rows = df.select("i", documents.quality(*args).alias("q"), documents.quality_reasons(*args, 0.6).alias("why"), documents.table_penalty(F.col("t")).alias("p")).orderBy("i").collect()
    assert rows[0]["why"] == [] and rows[0]["q"] > 0.75 > rows[1]["q"]
    assert {"high_illegible_density", "low_dictionary_word_ratio"} <= set(rows[1]["why"])
    assert rows[2]["p"] == 0 and "unstable_table_columns" not in rows[2]["why"]
    assert round(rows[3]["p"], 6) == round(0.12 * (8 / 3) ** 0.5 / 4, 6) and "unstable_table_columns" in rows[3]["why"]
    assert rows[4]["q"] == pytest.approx(0.468)


def test_profile_examples(spark):
    numbers = column(spark, [10.0, 20.0, 30.0, None, 100.0], "double")
    s = profile.numeric_stats(numbers, ["c0"]).first()
    assert (s["minimum"], s["maximum"], s["p50"]) == (10, 100, 25)
    counts = value_counts({"t": column(spark, ["open", "open", "open", "closed", "pending"])})
    top = profile.top_values(counts).orderBy("rank").first()
    assert (top["value"], top["n"], top["rate"]) == ("open", 3, 0.6)
    assert profile.signatures(counts).first()["signature"] == "a4"
    assert {r["value"] for r in profile.signature_outliers(counts).collect()} == {"closed", "pending"}
    spread = profile.samples(value_counts({"t": column(spark, [f"id-{i:03d}" for i in range(50)])}))
    assert [r["value"] for r in spread.orderBy("place").collect()] == ["id-000", "id-012", "id-024", "id-036", "id-049"]
    assert profile.nulls_and_distinct(value_counts({"t": column(spark, [None, None, None, "A"])})).first()["null_rate"] == 0.75


def test_relationship_examples(spark):
    ids = [f"C{i:03d}" for i in range(1, 7)]
    tables = {"orders": column(spark, ids + ids, name="customer_id"), "customers": column(spark, ids, name="id")}
    found = relate.candidates(tables).collect()
    assert len(found) == 1
    assert (found[0]["tab_a"], found[0]["direction"], found[0]["containment"]) == ("orders", "many_to_one", 1.0)
    joined = relate.join_by_link(tables, found[0].asDict())
    assert joined.count() == 12 and joined.columns == ["customer_id", "id"]
    odd = {"a": column(spark, [datetime.date(2024, 1, i) for i in range(1, 8)], "date", "d"), "b": column(spark, list(range(1, 8)), "int", "n")}
    assert relate.candidates(odd).count() == 0


def test_anomalies(spark):
    df = spark.createDataFrame([(i, float(i % 5), "x" if i else "odd", i) for i in range(200)] + [(200, 900.0, "x", 999)], "id long, v double, s string, fk long")
    parent = spark.createDataFrame([(i,) for i in range(200)], "k long")
    link = {"tab_a": "t", "col_a": "fk", "tab_b": "p", "col_b": "k", "direction": "many_to_one", "confirmed": True}
    found = anomalies.detect({"t": df}, {"t": "id"}, []).collect()
    assert {(r["detector"], r["row_id"]) for r in found if r["col"] in ("v", "s")} == {("mad", 200), ("rare_value", 0)}
    lost = anomalies.detect({"t": df, "p": parent}, {"t": "id", "p": "k"}, [link]).where("detector = 'orphan_key'").collect()
    assert [(r["row_id"], r["value"], r["score"]) for r in lost] == [(200, "999", 80.0)]


def test_validation(spark):
    df = spark.createDataFrame([("1.5", "abc", "01/02/2024"), ("2", "def", "03/04/2024"), ("3", "x", "05/06/2024")], "Amount string, Word string, Date string")
    rows = {r["col"]: r for r in validate.validate(df, {"Amount": "number", "Word": "date", "Date": "date"}).collect()}
    assert rows["Amount"]["confidence"] >= 0.95
    assert rows["Word"]["confidence"] < 0.85 and "type_parse_rate_low" in rows["Word"]["reasons"]
    assert "ambiguous_date_format" in rows["Date"]["reasons"]
    assert rows["Word"]["reasons"] == "type_parse_rate_low,type_kind_mismatch,format_signature_mismatch,validator_confidence_low"
    odd = spark.createDataFrame([("1.5", "no", None), ("2.5", "yes", None)], "column1 string, total_rate string, C string")
    rows = {r["col"]: r for r in validate.validate(odd, {"column1": "int", "total_rate": "category", "C": "string"}).collect()}
    assert rows["column1"]["reasons"] == "generic_column_name,type_parse_rate_low,type_kind_mismatch,validator_confidence_low" and rows["column1"]["type_score"] == 0
    assert rows["total_rate"]["reasons"] == "semantic_name_type_mismatch" and rows["C"]["reasons"] == "all_values_null"


def test_review(spark):
    raw = spark.createDataFrame([(0, "Report", None), (1, "Name", "Amount"), (2, "a", "1.5"), (3, None, None), (4, "b", "2.0")], "_row_id long, c0 string, c1 string")
    spec = review.Spec(1, (("name", "string", None), ("amount", "float", None)))
    spec = review.corrected(spec, {"op": "scale_column", "column": "amount", "factor": cells.scale_factor("Lakh")})
    assert [tuple(r) for r in review.preview(review.apply_header(raw, spec.header_row, list(spec.columns))).collect()] == [("a", 150000.0), ("b", 200000.0)]
    assert review.header_names(raw, 1) == ["Name", "Amount"] and review.unique_names(["Year", "Year", None]) == ["Year", "Year_2", "column_3"]
    assert review.is_structural({"op": "unheard_of"}) and not review.is_structural({"op": "set_usage_note"})
    with pytest.raises(KeyError):
        review.corrected(spec, {"op": "set_dtype", "column": "gone", "dtype": "int"})


def test_chunks(spark):
    page = "# Contract\n\n## Fees\n\nSection 4 Fees\n\n4.1 " + "The fee is due. " * 20 + "\n\n4.2 " + "Late fees apply. " * 20 + "\n\n" + "word " * 600
    rows = documents.chunks(spark.createDataFrame([(1, page), (2, None), (3, "")], "doc_id long, text string")).orderBy("chunk").collect()
    assert {r["doc_id"] for r in rows} == {1}
    first = next(r for r in rows if r["clause"] == "4.1")
    assert first["section"] == "4" and first["heading_path"] == ["Contract", "Fees", "Section 4: Fees"]
    assert page[first["start_char"] : first["end_char"]].startswith("4.1 The fee") and first["page"] == 1
    assert all(r["end_char"] - r["start_char"] <= documents.CHUNK for r in rows)
    assert "".join(r["text"] for r in rows).count("word") == 600


def test_spaced_events(spark):
    at = [0, 5, 9, 10, 12, 21, 30]
    start = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, i, start + datetime.timedelta(minutes=m)) for i, m in enumerate(at)], "user_id long, event_id long, ts timestamp_ntz")
    assert [r["event_id"] for r in usage.spaced(df).orderBy("event_id").collect()] == [0, 3, 5]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name;amount\nx;1\ny;2;3\n")
    (tmp_path / "b.csv").write_text("name;amount\nx;1\ny;2;3\n")
    raw = files.read_raw(spark, f"file://{tmp_path}/a.csv").orderBy("_row_id").collect()
    assert [tuple(r)[1:] for r in raw] == [("name", "amount", None), ("x", "1", None), ("y", "2", "3")]
    known = spark.createDataFrame([], "sha256 string")
    found = files.hashed(spark, f"file://{tmp_path}")
    assert files.new_files(found, known).count() == 1 and files.new_files(found, found).count() == 0
    with pytest.raises(files.UnsupportedFile):
        files.read_raw(spark, "x.pdf")
