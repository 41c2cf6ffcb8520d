"""Chart kinds and roles, and the catalog of approved tables, on small fixtures."""

import pytest

from lodemap.operators import catalog, widgets
from lodemap.operators.review import Spec


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "kind, columns, more, wanted",
    [
        ("bar", ["a", "b"], {}, "bar"),
        ("bar", ["a", "b"], {"title": "A Stacked Area of it"}, "stacked_area"),
        ("table", ["Source", " target", "n"], {}, "sankey"),
        ("table", ["start time", "event name"], {}, "timeline"),
        ("bar", ["a", "pct_done"], {}, "stacked_bar"),
        ("bar", ["a", "pct_done"], {"options": {"layout": "Horizontal"}}, "horizontal_bar"),
        ("bar", ["a", "b", "c"], {"several": True}, "grouped_bar"),
        ("bar", ["a", "b"], {"options": {"stacked": True}}, "stacked_bar"),
        ("line", ["a", "b"], {"title": "Area by day"}, "area"),
        ("pie", ["a", "share"], {"title": "histogram"}, "histogram"),
        ("pie", ["a", "share"], {"options": {"type": "histogram"}}, "pie"),
        ("bar", ["a", "b"], {"title": "Share of sales"}, "stacked_bar"),
        ("bar", ["a", "b"], {"caption": "by proportion"}, "stacked_bar"),
    ],
)
def test_chart_kind(kind, columns, more, wanted):
    assert widgets.chart_kind(kind, columns, **more) == wanted


def test_roles(spark):
    df = spark.createDataFrame([("1,000", "x", "north", 1), ("2", None, "south", 2)], "amount string, label string, area string, k int")
    assert widgets.roles(df) == widgets.Roles("label", "amount", "area", ("amount", "k"))
    assert widgets.roles(df, category="AREA", value="k").series == "label"
    numbers = spark.createDataFrame([(1, 2)], "a int, b int")
    assert widgets.roles(numbers) == widgets.Roles("a", "b", None, ("b",))
    assert widgets.roles(numbers.where("a > 1")).value == "b"


def test_chart_number(spark):
    df = spark.createDataFrame([(x,) for x in ("1,234.5", " -2 ", "1e999", "1d", "", "NaN", "x", None, ".5")], "x string")
    assert [r[0] for r in df.select(widgets.chart_number(df.x)).collect()] == [1234.5, -2.0, None, None, None, None, None, None, 0.5]


def test_series_takes_first_match_in_order_of_rows(spark):
    df = spark.createDataFrame([(1, "b", "u", "5"), (2, "a", "u", "x"), (3, "a", "u", "7"), (4, "b", "v", "1"), (5, "b", "u", "9"), (6, None, "v", "2")], "k int, c string, s string, v string")
    out = widgets.first_match_series(df, "c", "s", "v", {"u": "u", "v": "v"}, "k")
    assert rows(out) == [("", 2, 0.0, 2.0), ("a", 1, 0.0, 0.0), ("b", 0, 5.0, 1.0)]
    assert rows(widgets.first_match_series(df.where("k > 9"), "c", "s", "v", {"u": "u"}, "k")) == []


def test_boxes_matching_and_scatter(spark):
    df = spark.createDataFrame([("a", 1, 2, 3, 4, None)], "g string, a int, b int, c int, d int, e int")
    assert rows(widgets.given_five_numbers(df, "g", list("abcde"))) == [("a", 1.0, 2.0, 3.0, 4.0, 0.0)]
    with pytest.raises(ValueError):
        widgets.given_five_numbers(df, "g", ["a"])
    t = spark.createDataFrame([("Abc", None), (None, "xaBy"), ("no", "no")], "p string, `q.r` string")
    assert len(rows(widgets.matching(t, "AB"))) == 2 and widgets.matching(t, "").count() == 3
    assert rows(widgets.scatter(df, "a", "b", "e", "g")) == [(1.0, 2.0, 8.0, "a")] and rows(widgets.scatter(df, "a", "e")) == []


FILES = [("f1", "One", "about", 0, 2), ("f2", "Two", " ", 7, 1), ("f3", "Three", None, 5, 3)]
COLUMNS = [("f1", "id", "int", "key", 1.0, 0), ("f1", "when", "date", "", 0.5, 1), ("f2", "one_id", "int", "key", None, 0)]
LINKS = [("f1", "id", "f2", "one_id", 0.8), ("f2", "x", "f1", "y", 1.0)]


@pytest.fixture
def tables(spark):
    return (
        spark.createDataFrame(FILES, "file_id string, name string, description string, header_row int, place int"),
        spark.createDataFrame(COLUMNS, "file_id string, name string, dtype string, description string, confidence double, place int"),
        spark.createDataFrame(LINKS, "file_a string, col_a string, file_b string, col_b string, score double"),
    )


def test_warnings(tables):
    files, columns, links = tables
    wanted = [
        ("f1", "columns_without_meaning", None), ("f1", "unsure_column", "when"), ("f1", "unsure_link", "id = one_id"), ("f2", "deep_header", None), ("f2", "no_description", None),
        ("f2", "unsure_link", "id = one_id"), ("f3", "no_columns", None), ("f3", "no_description", None), ("f3", "no_link", None),
    ]
    assert rows(catalog.warnings(*tables)) == sorted(wanted, key=repr)
    one = files.where("file_id = 'f3'")
    assert ("f3", "no_link", None) not in rows(catalog.warnings(one, columns.where("false"), links.where("false")))


def test_links_by_pair(tables):
    files, _, links = tables
    assert rows(catalog.links_by_pair(links, files)) == [("f2", "f1", 2)] and rows(catalog.links_by_pair(links)) == [("f1", "f2", 2)]
    assert [r.review for r in catalog.labelled_links(links).orderBy("score").collect()] == [True, False]


def test_fields_asked_again_stand_only_if_surer(tables):
    _, columns, _ = tables
    assert [r.name for r in catalog.fields_to_ask(columns).collect()] == ["when"]
    ask = lambda df: df.selectExpr("file_id", "name", "'datetime' as dtype", "'moment' as description")
    for score, kept in ((0.9, "datetime"), (0.4, "date")):
        out = catalog.asked_again(columns, ask, lambda df: df.selectExpr("*", f"{score}D as confidence"))
        assert out.columns == columns.columns and out.count() == 3
        assert out.where("name = 'when'").first().dtype == kept


def test_key_fields_and_refresh(tables, spark):
    _, columns, _ = tables
    assert [r[1] for r in rows(catalog.key_fields(columns, 1))] == ["id", "one_id"]
    assert [r[1] for r in rows(catalog.key_fields(columns, 1, ["WHEN"]))] == ["when", "one_id"]
    old = spark.createDataFrame([("f1", "a row an order", " "), ("f9", "gone", "x")], "file_id string, grain string, role string")
    new = spark.createDataFrame([("f1", "new", "fact"), ("f2", "new", "list")], "file_id string, grain string, role string")
    assert rows(catalog.refreshed(old, new, ["file_id"], ["grain", "role"])) == [("f1", "a row an order", "fact"), ("f2", "new", "list")]


def test_approval_and_minor_corrections(spark):
    raw = spark.createDataFrame([(0, "id", "amount"), (1, "1", "2.5"), (2, None, None)], "_row_id long, c0 string, c1 string")
    spec = catalog.corrected_all(Spec(0, (("id", "int", None), ("amount", "float", None))), [{"op": "rename_column", "column": "id", "to": "key"}, {"op": "scale_column", "column": "amount", "factor": 10.0}])
    made, links = catalog.approved({"t": raw, "other": raw}, {"t": spec, "absent": spec}, [{"tab_a": "t", "score": 0.2}])
    assert list(made) == ["t"] and rows(made["t"].drop("_row_id")) == [(1, 25.0)]
    assert links == [{"tab_a": "t", "score": 1.0, "origin": "user_added"}]
    notes = catalog.with_minor({"notes": ["old"], "glossary": {"a": "1"}}, {"op": "set_usage_note", "text": "new"})
    assert notes["notes"] == ["new"] and catalog.with_minor(notes, {"op": "set_glossary_term", "term": "b", "text": "2"})["glossary"] == {"a": "1", "b": "2"}
    with pytest.raises(ValueError):
        catalog.with_minor({}, {"op": "set_dtype"})


def test_simple_dtypes_and_preview(spark):
    data = [(i, str(i), f"{i}.5", "yes" if i % 2 else "N", "2024-01-0%d" % (i % 9 + 1), f"name {i}", "ab"[i % 2], " ", "x") for i in range(60)]
    df = spark.createDataFrame(data, "_row_id long, a string, b string, c string, d string, e string, f string, g string, due_date string")
    wanted = {"a": "int", "b": "float", "c": "bool", "d": "datetime", "e": "string", "f": "category", "g": "string", "due_date": "date"}
    assert catalog.simple_dtypes(df.drop("_row_id")) == wanted
    assert set(catalog.simple_dtypes(df.where("false").drop("_row_id")).values()) == {"string", "date"}
    head, n = catalog.preview_rows(None, df)
    assert (head.count(), n) == (12, 60) and "_row_id" not in head.columns


def test_value_sets_of_more_columns_than_a_word_has_bits(spark):
    from lodemap.operators import relate

    wide = spark.createDataFrame([tuple(range(k, k + 70)) for k in (0, 1000)], [f"c{i}" for i in range(70)])
    other = spark.createDataFrame([(0,), (69,), (1069,), (None,), (5000,)], "k long")
    out = {(r.col_a, r.col_b): (r.shared, round(r.containment, 4)) for r in relate.overlaps({"w": wide, "o": other}).collect()}
    assert out == {("c0", "k"): (1, 0.5), ("k", "c0"): (1, 0.25), ("c69", "k"): (2, 1.0), ("k", "c69"): (2, 0.5)}
    assert relate.overlaps({"w": wide.limit(0), "o": other.limit(0)}).count() == 0
