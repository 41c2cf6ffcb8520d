"""Chart shapes from tables: bins, quartiles, running bases, matrices, links, lanes.

Positions of labels come from their distinct values, which a chart can show, never
from a window over all rows in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import quantiles, ranked

BINS, FEWEST, MOST = 12, 2, 40


def places(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name int): the place of each distinct value in order."""
    return ranked(df.select(column).distinct(), [column], name=name).select(column, F.col(name).cast("int").alias(name))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin int, low, high, n): equal bins, empty ones too, the last one closed; a column of one value has bins of width 1."""
    bins = max(FEWEST, min(MOST, bins))
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    edge = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("width", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0))
    place = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / F.col("width"))).cast("int")
    counts = x.crossJoin(F.broadcast(edge)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # a one-row side
    every = edge.where("lo is not null").select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    low = lambda k: F.round(F.col("lo") + (F.col("bin") + k) * F.col("width"), 4)
    return every.join(counts, "bin", "left").select("bin", low(0).alias("low"), low(1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def five_numbers(df: DataFrame, group: str, column: str) -> DataFrame:
    """(grp, low, q1, q2, q3, high) of each group with a value."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(group).alias("grp"), F.col(column).alias("x"))
    ends, q = rows.groupBy("grp").agg(F.min("x").alias("low"), F.max("x").alias("high")), quantiles(rows, "x", [0.25, 0.5, 0.75], ["grp"])
    out = ends.join(q.withColumnRenamed("grp", "_grp"), F.col("grp").eqNullSafe(F.col("_grp")))
    return out.select("grp", "low", *[F.round(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)], "high")


def waterfall(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label, value, base, total): running totals of a chart's bars, in order of the label. The rows are those of one chart."""
    order = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    out = df.select(F.col(label).alias("label"), F.col(value).alias("v")).withColumn("t", F.sum("v").over(order))
    base = F.when(F.col("v") >= 0, F.col("t") - F.col("v")).otherwise(F.col("t"))
    return out.select("label", F.round("v", 2).alias("value"), F.round(base, 2).alias("base"), F.round("t", 2).alias("total"))


def heatmap(cells: DataFrame) -> DataFrame:
    """(y, x, row, col, value): cells with the places of their labels."""
    rows, cols = places(cells, "y", "row"), places(cells, "x", "col")
    return cells.join(rows, "y").join(cols, "x").select("y", "x", "row", "col", "value")


def series(df: DataFrame, category: str, by: str, value: str, names: dict) -> DataFrame:
    """One row a category, a column for each named series; what is missing is 0."""
    out = df.groupBy(F.col(category).alias("category")).pivot(by, list(names)).agg(F.round(F.sum(value), 2))
    return out.select("category", *[F.coalesce(F.col(str(k)), F.lit(0.0)).alias(n) for k, n in names.items()])


def crosstab(df: DataFrame, rows: str, by: str, names: dict) -> DataFrame:
    """Counts by two columns, with a total for each row (n) and one row ``All``."""
    counts = [F.count_if(F.col(by) == k).alias(n) for k, n in names.items()]
    return df.rollup(rows).agg(*counts, F.count("*").alias("n")).withColumn(rows, F.coalesce(rows, F.lit("All")))


def quantile_bins(df: DataFrame, column: str, k: int, name: str) -> DataFrame:
    """Adds the quantile bin of each row, by exact edges, each bin closed above."""
    edges = quantiles(df, column, [i / k for i in range(1, k)]).select(F.col("q").alias("_edges"))
    held = df.crossJoin(F.broadcast(edges))  # a one-row side
    return held.withColumn(name, F.size(F.filter("_edges", lambda e: e < F.col(column))).cast("int")).drop("_edges")


def top_n(df: DataFrame, k: int) -> DataFrame:
    """The k largest of (label, value), with their place."""
    best = df.orderBy(F.desc("value"), "label").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "label")))


def timeline(df: DataFrame, ident: str, group: str, moment: str) -> DataFrame:
    lanes = places(df.select(F.coalesce(F.col(group), F.lit("events")).alias("grp")), "grp", "lane")
    rows = df.select(ident, F.coalesce(F.col(group), F.lit("events")).alias("grp"), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    return rows.join(lanes, "grp").select(ident, "grp", "lane", "at")


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BARS, SLICES, CARDS, SCATTER_SIZE = 10, 8, 4, 8.0


def chart_number(cell: Column) -> Column:
    """The finite number in a cell of any type, with or without grouping commas; else null."""
    text = F.trim(F.replace(cell.cast("string"), F.lit(","), F.lit("")))
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def chart_text(cell: Column) -> Column:
    return F.coalesce(cell.cast("string"), F.lit(""))


def first_seen(df: DataFrame, column: str, name: str, order: str) -> DataFrame:
    """(column, name int): the place of each distinct label by its first row; the labels are those that a chart shows."""
    labels = df.groupBy(column).agg(F.min(order).alias("_seen"))
    return ranked(labels, ["_seen"], name=name).select(column, F.col(name).cast("int").alias(name))


def items(df: DataFrame, category: str, value: str, order: str) -> DataFrame:
    """(order, label, value): one bar for each row with a numeric value."""
    return df.select(F.col(order), chart_text(F.col(category)).alias("label"), chart_number(F.col(value)).alias("value")).where("value is not null")


def first_items(df: DataFrame, order: str, k: int | None = BARS) -> DataFrame:
    """The first bars or slices as they come, not the largest; all without ``k``."""
    return df if k is None else df.orderBy(order).limit(k)


def first_match_series(df: DataFrame, category: str, by: str, value: str, names: dict, order: str) -> DataFrame:
    """(category, place int, a column for each named series): the value of the first row of each pair, 0 without one or a number.

    Categories are placed by their first row, whatever its series.
    """
    first = lambda k: F.min_by(chart_number(F.col(value)), F.when(F.col(by) == k, F.col(order)))
    out = df.groupBy(F.col(category).alias("category")).agg(F.min(order).alias("_seen"), *[F.coalesce(first(k), F.lit(0.0)).alias(n) for k, n in names.items()])
    placed = ranked(out, ["_seen"], name="place")
    return placed.select(chart_text(F.col("category")).alias("category"), F.col("place").cast("int").alias("place"), *names.values())


def wide_series(df: DataFrame, category: str, columns: list[str], order: str) -> DataFrame:
    """(order, category, series, value): each numeric column is a series; what is no number is 0."""
    cells = [F.struct(F.lit(c).alias("series"), F.coalesce(chart_number(F.col(f"`{c}`")), F.lit(0.0)).alias("value")) for c in columns]
    return df.select(F.col(order), chart_text(F.col(category)).alias("category"), F.inline(F.array(*cells)))


def scatter(df: DataFrame, x: str, y: str, size: str | None = None, label: str | None = None) -> DataFrame:
    """(x, y, size, label): points that have both numbers; the size is 8 and the label empty where none is given."""
    wide = F.coalesce(chart_number(F.col(size)), F.lit(SCATTER_SIZE)) if size else F.lit(SCATTER_SIZE)
    points = df.select(chart_number(F.col(x)).alias("x"), chart_number(F.col(y)).alias("y"), wide.alias("size"), (chart_text(F.col(label)) if label else F.lit("")).alias("label"))
    return points.where("x is not null and y is not null")


def heatmap_cells(df: DataFrame, x: str, y: str, value: str, order: str) -> DataFrame:
    """(x, y, col, row, value): cells with a number, at the places of their labels by first appearance."""
    cells = df.select(F.col(order).alias("_order"), chart_text(F.col(x)).alias("x"), chart_text(F.col(y)).alias("y"), chart_number(F.col(value)).alias("value")).where("value is not null")
    cols, rows = first_seen(cells, "x", "col", "_order"), first_seen(cells, "y", "row", "_order")
    return cells.join(cols, "x").join(rows, "y").select("x", "y", "col", "row", "value")


def heatmap_matrix(df: DataFrame, category: str, columns: list[str], order: str) -> DataFrame:
    """The same from a table of numbers: a row of the map for each row, a column for each numeric column."""
    names = F.array(*[F.lit(c) for c in columns])
    cells = wide_series(df, category, columns, order).withColumnsRenamed({"series": "x", "category": "y"})
    return cells.withColumn("col", (F.array_position(names, F.col("x")) - 1).cast("int")).select(order, "x", "y", "col", "value")


def given_five_numbers(df: DataFrame, category: str, columns: list[str]) -> DataFrame:
    """Boxes whose five numbers are the first five numeric columns of a table."""
    if len(columns) < 5:
        raise ValueError("five numeric columns make a box")
    parts = [F.coalesce(chart_number(F.col(f"`{c}`")), F.lit(0.0)).alias(n) for c, n in zip(columns, ("low", "q1", "q2", "q3", "high"))]
    return df.select(chart_text(F.col(category)).alias("grp"), *parts)


def sankey(df: DataFrame, source: str, target: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Links (source, target, value) that have a number, and their distinct nodes (name)."""
    links = df.select(chart_text(F.col(source)).alias("source"), chart_text(F.col(target)).alias("target"), chart_number(F.col(value)).alias("value")).where("value is not null")
    nodes = links.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    return links, nodes


def cards(df: DataFrame, order: str, k: int = CARDS) -> DataFrame:
    """The figures of a card: the first few items."""
    return df.orderBy(order).limit(k)


def matching(df: DataFrame, asked: str) -> DataFrame:
    """Rows of which any cell holds the asked text, in any case; all rows for an empty one."""
    if not asked:
        return df
    hit = [F.contains(F.lower(F.col(f"`{c}`").cast("string")), F.lit(asked.lower())) for c in df.columns]
    return df.where(F.greatest(*[F.coalesce(h, F.lit(False)) for h in hit]) if len(hit) > 1 else hit[0])


@dataclass(frozen=True)
class Roles:
    """Columns by what they hold: category and value always, series where there is one; and all numeric columns but the category."""

    category: str
    value: str
    series: str | None
    numeric: tuple[str, ...]


def roles(df: DataFrame, category: str | None = None, value: str | None = None, series: str | None = None) -> Roles:
    """The category is the first column with a cell that is no number, the value the first other one with a number,
    the series the first remaining one with text.  Names that are given go first, in any case of letters.  One aggregate."""
    named = {c.lower(): c for c in reversed(df.columns)}
    cell = {c: F.col(f"`{c}`") for c in df.columns}
    number = {c: chart_number(cell[c]).isNotNull() for c in df.columns}
    counts = [F.count_if(number[c]).alias(f"n{i}") for i, c in enumerate(df.columns)]
    counts += [F.count_if(~number[c]).alias(f"t{i}") for i, c in enumerate(df.columns)]
    counts += [F.count_if(~number[c] & (chart_text(cell[c]) != "")).alias(f"w{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*counts).first()
    having = lambda kind, but: [c for i, c in enumerate(df.columns) if c not in but and row[f"{kind}{i}"]]
    first = lambda given, found, other: named.get((given or "").lower()) or next(iter(found), other)
    label = first(category, having("t", ()), df.columns[0])
    numeric = having("n", (label,))
    amount = first(value, numeric, df.columns[1 if label == df.columns[0] and len(df.columns) > 1 else 0])
    return Roles(label, amount, first(series, having("w", (label, amount)), None), tuple(numeric))


# Phrases of a title that ask for a chart, in the order in which they are looked for.
PHRASES = {
    "stacked area": "stacked_area", "area chart": "area", "histogram": "histogram", "scatterplot": "scatter", "scatter plot": "scatter", "heatmap": "heatmap", "heat map": "heatmap",
    "boxplot": "boxplot", "box plot": "boxplot", "waterfall": "waterfall", "sankey": "sankey", "timeline": "timeline", "horizontal bar": "horizontal_bar", "grouped bar": "grouped_bar",
    "stacked bar": "stacked_bar", "stacked chart": "stacked_bar",
}
PARTS_OF_WHOLE = ("pct", "percent", "share", "proportion")
ASKED_BY = ("chartType", "variant", "layout", "orientation", "type")


def chart_kind(kind: str, columns: list[str], title: str = "", caption: str = "", options: dict | None = None, several: bool = False) -> str:
    """The kind of chart that is meant: by the words of its title and options, else by its columns.

    ``several`` says that the table holds more than one series (see ``roles``).
    """
    options = options or {}
    asked = [str(options[k]).strip().lower() for k in ASKED_BY if options.get(k) is not None]
    title = f"{title or ''} {caption or ''}".lower()
    text = " ".join([title, *asked])
    names = [c.strip().lower() for c in columns]
    told = text if kind in ("bar", "line", "table") else title
    kind = next((found for phrase, found in PHRASES.items() if phrase in told), kind)
    if kind == "table":
        if {"source", "target"} <= set(names):
            return "sankey"
        return "timeline" if any("time" in n for n in names) and any("event" in n for n in names) else kind
    if kind == "line":
        return "area" if "area" in text else kind
    if kind != "bar":
        return kind
    wanted = lambda *words: any(w in asked for w in words)
    if wanted("horizontal", "horizontal_bar"):
        return "horizontal_bar"
    if wanted("stacked", "stacked_bar") or options.get("stacked") is True or any(p in n for p in PARTS_OF_WHOLE for n in names) or any(p in title for p in PARTS_OF_WHOLE[2:]):
        return "stacked_bar"
    return "grouped_bar" if wanted("grouped", "grouped_bar") or several else "bar"
