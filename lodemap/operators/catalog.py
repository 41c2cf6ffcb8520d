"""The catalog of approved tables as tables: warnings, links, key fields, refreshed notes, fields to ask again.

``files``: (file_id, name, description, header_row, place); ``columns``: (file_id,
name, dtype, description, confidence, place); ``links``: (file_a, col_a, file_b,
col_b, score).  Null texts count as empty, null scores as sure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import FALSE_WORDS, FORMATS, TRUE_WORDS, to_time
from .review import Spec, apply_header, corrected
from .widgets import chart_number

SURE, DEEP_HEADER, ASK_AGAIN, KEY_FIELDS = 0.85, 5, 20, 5
SHARE, CATEGORIES = 0.9, 20


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def unsure(score: Column) -> Column:
    return F.coalesce(score, F.lit(1.0)) < SURE


def labelled_links(links: DataFrame) -> DataFrame:
    """Links with ``review``: whether they are below the score that needs no look."""
    return links.withColumn("review", unsure(F.col("score")))


def warnings(files: DataFrame, columns: DataFrame, links: DataFrame) -> DataFrame:
    """(file_id, warning, subject): one row for each thing to look at.

    A link that is unsure warns at both its files; files without a link are only
    warned of where there is more than one file.
    """
    own = columns.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(blank(F.col("description"))).alias("bare"))
    facts = files.join(own, "file_id", "left").select(
        "file_id",
        F.array_compact(
            F.array(
                F.when(blank(F.col("description")), F.lit("no_description")),
                F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("no_columns")),
                F.when(F.coalesce("bare", F.lit(0)) > 0, F.lit("columns_without_meaning")),
                F.when(F.col("header_row") > DEEP_HEADER, F.lit("deep_header")),
            )
        ).alias("all"),
    )
    of_files = facts.select("file_id", F.explode("all").alias("warning"), F.lit(None).cast("string").alias("subject"))
    of_columns = columns.where(unsure(F.col("confidence"))).select("file_id", F.lit("unsure_column").alias("warning"), F.col("name").alias("subject"))
    ends = links.select(F.explode(F.array("file_a", "file_b")).alias("file_id"), "col_a", "col_b", "score")
    of_links = ends.where(unsure(F.col("score"))).select("file_id", F.lit("unsure_link").alias("warning"), F.concat_ws(" = ", "col_a", "col_b").alias("subject"))
    several = files.agg((F.count("*") > 1).alias("several"))
    alone = files.join(ends.select("file_id").distinct(), "file_id", "left_anti").crossJoin(F.broadcast(several)).where("several")  # a one-row side
    unlinked = alone.select("file_id", F.lit("no_link").alias("warning"), F.lit(None).cast("string").alias("subject"))
    return of_files.unionByName(of_columns).unionByName(of_links).unionByName(unlinked)


def links_by_pair(links: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(left_file, right_file, n_links): links of two files in either direction, the file that is placed first on the left; without ``files`` the smaller id."""
    if files is None:
        left, right = F.least("file_a", "file_b"), F.greatest("file_a", "file_b")
        return links.groupBy(left.alias("left_file"), right.alias("right_file")).agg(F.count("*").alias("n_links"))
    place = files.select("file_id", "place")
    for end in ("a", "b"):
        links = links.join(place.withColumnsRenamed({"file_id": f"file_{end}", "place": f"place_{end}"}), f"file_{end}", "left")
    last = F.lit((1 << 62))
    first = F.coalesce("place_a", last) <= F.coalesce("place_b", last)
    left, right = F.when(first, F.col("file_a")).otherwise(F.col("file_b")), F.when(first, F.col("file_b")).otherwise(F.col("file_a"))
    return links.groupBy(left.alias("left_file"), right.alias("right_file")).agg(F.count("*").alias("n_links"))


def field_rank(name: Column, dtype: Column) -> Column:
    """Keys, amounts, dates, classes, numbers, then the rest."""
    low = F.lower(name)
    return (
        F.when((low == "id") | low.endswith("_id"), 0)
        .when(low.rlike("amount|price|cost|value|total|balance|revenue"), 1)
        .when(dtype.isin("date", "datetime"), 2)
        .when(dtype.isin("category", "bool"), 3)
        .when(dtype.isin("int", "float"), 4)
        .otherwise(5)
    )


def key_fields(columns: DataFrame, k: int = KEY_FIELDS, first: list[str] = ()) -> DataFrame:
    """(file_id, name, dtype, place): the fields that stand for a table; the names in ``first`` go before all others, in that order."""
    wanted = F.array_position(F.array(*[F.lit(n.lower()) for n in first]), F.lower("name")) if first else F.lit(0)
    order = Window.partitionBy("file_id").orderBy((wanted == 0), wanted, field_rank(F.col("name"), F.col("dtype")), "name")
    return columns.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("file_id", "name", "dtype", "place")


def fields_to_ask(columns: DataFrame, limit: int = ASK_AGAIN) -> DataFrame:
    """The least sure fields, at most ``limit`` of them: a bounded list for a reviewer."""
    return columns.where(unsure(F.col("confidence"))).orderBy("confidence", "file_id", "name").limit(limit)


def asked_again(columns: DataFrame, ask: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame], limit: int = ASK_AGAIN) -> DataFrame:
    """Columns after another look at the least sure ones.

    ``ask`` answers (file_id, name, dtype, description) for the fields it is given,
    ``check`` gives each row a new ``confidence``.  An answer stands only if it is surer than what it replaces.
    """
    keys = ["file_id", "name"]
    answers = ask(fields_to_ask(columns, limit)).select(*keys, "dtype", "description")
    new = check(answers).select(*keys, *[F.col(c).alias(f"_{c}") for c in ("dtype", "description", "confidence")])
    better = F.col("_confidence") > F.col("confidence")
    held = columns.join(F.broadcast(new), keys, "left")  # at most ``limit`` rows
    return held.select(*[F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if f"_{c}" in new.columns else F.col(c) for c in columns.columns])


def refreshed(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """New notes on tables or columns; the fields ``kept`` stay as a person left them, where there was anything."""
    before = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in kept])
    held = new.join(before, keys, "left")
    return held.select(*[F.coalesce(F.when(~blank(F.col(f"_{c}").cast("string")), F.col(f"_{c}")), F.col(c)).alias(c) if c in kept else F.col(c) for c in new.columns])


def approved(raw: dict[str, DataFrame], specs: dict[str, Spec], links: list[dict]) -> tuple[dict[str, DataFrame], list[dict]]:
    """Every table cast as approved, and the links a person confirmed in place of all others, each sure.

    A table without an approved spec is left out.  All casts are plans; only the votes on columns run at once.
    """
    tables = {name: apply_header(raw[name], s.header_row, list(s.columns)) for name, s in specs.items() if name in raw}
    return tables, [{**x, "score": 1.0, "origin": "user_added"} for x in links]


def with_minor(notes: dict, operation: dict) -> dict:
    """New notes of a table after a correction that changes no data.  A note or question replaces those there were, terms add up."""
    op = operation["op"]
    if op in ("set_friendly_name", "set_file_description"):
        return {**notes, "name" if op == "set_friendly_name" else "description": operation["text"]}
    if op == "set_column_description":
        return {**notes, "columns": {**notes.get("columns", {}), operation["column"]: operation["text"]}}
    if op == "set_glossary_term":
        return {**notes, "glossary": {**notes.get("glossary", {}), operation["term"]: operation["text"]}}
    if op in ("set_usage_note", "set_starter_question"):
        return {**notes, "notes" if op == "set_usage_note" else "questions": [operation["text"]]}
    raise ValueError(f"not a minor correction: {op!r}")


def corrected_all(spec: Spec, operations: list[dict]) -> Spec:
    for operation in operations:
        spec = corrected(spec, operation)
    return spec


def simple_dtypes(df: DataFrame) -> dict[str, str]:
    """A type for each column of a raw table that nobody has approved: date by its name, then bool, int, float, datetime, category.

    One aggregate, and one of distinct values for the columns left.  Blank cells don't count; numbers and dates need nine tenths of the others.
    """
    counts = []
    for i, c in enumerate(df.columns):
        cell = F.trim(F.col(f"`{c}`").cast("string"))
        cell = F.when(cell != "", cell)
        low, number = F.lower(cell), chart_number(F.when(~F.contains(cell, F.lit(",")), cell))
        moment = F.coalesce(*[to_time(cell, f) for f in FORMATS])
        counts += [
            F.count(cell).alias(f"n{i}"),
            F.count_if(low.isin(*TRUE_WORDS, *FALSE_WORDS)).alias(f"bool{i}"),
            F.count(number).alias(f"number{i}"),
            F.count_if(number == F.floor(number)).alias(f"whole{i}"),
            F.count(moment).alias(f"moment{i}"),
        ]
    row = df.agg(*counts).first()
    out, left = {}, {}
    for i, c in enumerate(df.columns):
        n, whole = row[f"n{i}"], row[f"whole{i}"] == row[f"number{i}"]
        if "date" in c.lower():
            out[c] = "date"
        elif not n:
            out[c] = "string"
        elif row[f"bool{i}"] == n:
            out[c] = "bool"
        elif row[f"number{i}"] >= SHARE * n:
            out[c] = "int" if whole else "float"
        elif row[f"moment{i}"] >= SHARE * n:
            out[c] = "datetime"
        else:
            out[c] = "string"
            left[c] = max(CATEGORIES, n // 20)
    if left:
        distinct = df.agg(*[F.count_distinct(F.nullif(F.lower(F.trim(F.col(f"`{c}`").cast("string"))), F.lit(""))).alias(f"d{i}") for i, c in enumerate(left)]).first()
        out |= {c: "category" for i, (c, most) in enumerate(left.items()) if distinct[f"d{i}"] <= most}
    return out


def preview_rows(processed: DataFrame | None, raw: DataFrame, k: int = 12) -> tuple[DataFrame, int]:
    """The first rows of the processed table, or of the raw one if there is none, and how many rows it has."""
    shown = raw if processed is None else processed
    return shown.orderBy("_row_id").limit(k).drop("_row_id"), shown.count()
