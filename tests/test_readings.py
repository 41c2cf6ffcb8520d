"""Readings of cells, counted by mask, against parsing each cell by each reading."""

from pyspark.sql import functions as F

from lodemap.functions import cells
from lodemap.operators import review

CELLS = [
    "1/2/2020", "31/02/2020", "29/2/2021", "29.2.00", "12/31/99", "2020-01-01 24:00:00", "2020-1-1 3:4:5", "2020-01-01T00:00:00", "5/6/2020 1:2", "20200230", "20200229", "1900-2-29",
    "1-Jan-2020", "31-Feb-2020", "March 3, 2021", "DD/DD/DDDD", "1/2/2020\n", "(5)\n", "₹ 1,200.50", "-1,5", "1e5", "(1,5)", "(", "", "yes", "2 weeks ago", "0/1/2020", None,
]


def test_counts_equal_parsing(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "i int, cell string")
    cell = cells.clean_cell(F.col("cell"))
    wanted = df.select("i", *[cells.to_time(cell, f).isNotNull().alias(f"date{k}") for k, f in enumerate(cells.FORMATS)], cells.to_number(cell).isNotNull().alias("number")).collect()
    wide = df.groupBy().pivot("i", list(range(len(CELLS)))).agg(F.first("cell"))
    got = cells.count_readings(wide, wide.columns)
    for r in wanted:
        assert {k: bool(got[str(r["i"])][k]) for k in r.asDict() if k != "i"} == {k: bool(v) for k, v in r.asDict().items() if k != "i"}, CELLS[r["i"]]


def test_cells_are_cast_once(spark):
    """The test for empty rows stays above the casts."""
    raw = spark.createDataFrame([(0, "a", "b"), (1, "1,200", "3/2/2020"), (2, None, "n/a"), (3, "(5)", "14/2/2020")], "_row_id long, c0 string, c1 string")
    out = review.apply_header(raw, 0, [("a", "int", None), ("b", "date", None)])
    assert [tuple(map(str, r)) for r in out.orderBy("_row_id").collect()] == [("1", "1200", "2020-02-03"), ("3", "-5", "2020-02-14")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("gettimestamp") == 1
