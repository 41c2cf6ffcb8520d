"""How far declared column types fit the data: a confidence for each column, with reasons."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import clean_cell, count_readings, decide, dtype_of
from ..functions.text import signature

# Weights and scores of the parts.
TYPE_WEIGHT, MEANING_WEIGHT, HEADER_WEIGHT = 0.65, 0.20, 0.15
GOOD, LOW = 0.85, 0.5
AMOUNT_WORDS = ("amount", "price", "total", "rate")
# Fixed value: names of columns that say nothing.
GENERIC = r"c\d+|column\d+|unnamed:?\s*\d*"


def header_score(name: str, names: list[str]) -> tuple[float, list[str]]:
    if not name.strip():
        return 0.0, ["empty_column_name"]
    score, reasons = 1.0, []
    if [n.strip().lower() for n in names].count(name.strip().lower()) > 1:
        score, reasons = 0.55, ["duplicate_column_name"]
    if re.fullmatch(GENERIC, name.strip().lower()):
        score, reasons = min(score, 0.75), [*reasons, "generic_column_name"]
    return score, reasons


def validate(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """(col, dtype, type_score, meaning_score, header_score, confidence double, reasons string) of each declared column.

    One grouping over all rows counts what parses in all columns, others find the most
    frequent signatures and the distinct values, of the columns whose scores ask for
    them; the scores are arithmetic on those counts.
    """
    df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in declared])
    kinds = {c: dtype_of(kind) for c, kind in declared.items()}
    found = count_readings(df, list(declared))
    signed = _cells(df, [c for c, k in kinds.items() if k in ("int", "float", "date", "datetime")])
    signed = signed.groupBy("col", signature(F.col("cell")).alias("signature")).agg(F.count("*").alias("n"))
    most = {r["col"]: r["s"] for r in signed.groupBy("col").agg(F.min_by("signature", F.struct(-F.col("n"), "signature")).alias("s")).collect()}
    values = _cells(df, [c for c, k in kinds.items() if k in ("bool", "category")]).distinct()
    distinct = {r["col"]: r["n"] for r in values.groupBy("col").agg(F.count("*").alias("n")).collect()}
    rows = []
    for name, kind in kinds.items():
        counts = found[name] | {"signature": most.get(name), "distinct": distinct.get(name, 0)}
        rows.append(score_column(name, kind, counts, list(declared)))
    return df.sparkSession.createDataFrame(rows, "col string, dtype string, type_score double, meaning_score double, header_score double, confidence double, reasons string")


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, cell) of the cells that hold something."""
    cells = [F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").alias("cell")) for c in columns]
    if not cells:
        return df.select(F.lit("").alias("col"), F.lit("").alias("cell")).where(F.lit(False))
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.col", clean_cell(F.col("c.cell")).alias("cell")).where("cell is not null")


def score_column(name: str, dtype: str, counts: dict[str, int], names: list[str]) -> tuple:
    n, pattern = counts["n"], counts["signature"] or ""
    vote = decide(counts)
    head, reasons = header_score(name, names)
    fits, kinds = 0.95, {"int": ("int",), "float": ("int", "float"), "date": ("datetime",), "datetime": ("datetime",)}.get(dtype)
    if not n:
        fits, reasons = 0.65, [*reasons, "all_values_null"]
    elif kinds:
        fits = vote.confidence if vote.kind in kinds else 0.0
        if dtype in ("date", "datetime") and vote.reasons:
            fits, reasons = min(fits, vote.confidence), [*reasons, *vote.reasons]
        if fits < GOOD:
            reasons = [*reasons, "type_parse_rate_low"]
        if vote.kind not in kinds:
            reasons = [*reasons, "type_kind_mismatch"]
    elif dtype == "bool":
        fits = counts["bool"] / n
        if fits < GOOD:
            reasons = [*reasons, "type_parse_rate_low"]
        if counts["distinct"] <= 2:
            fits = max(fits, GOOD)
    elif dtype == "category" and counts["distinct"] > 50 and counts["distinct"] / n > 0.5:
        fits, reasons = 0.65, [*reasons, "high_cardinality_category"]
    meaning = 1.0
    if "D" not in pattern and (dtype in ("date", "datetime") or (dtype in ("int", "float") and pattern)):
        meaning, reasons = 0.6, [*reasons, "format_signature_mismatch"]
    elif dtype == "category" and any(w in name.lower() for w in AMOUNT_WORDS):
        meaning, reasons = 0.75, [*reasons, "semantic_name_type_mismatch"]
    sure = round(max(0.0, min(1.0, TYPE_WEIGHT * fits + MEANING_WEIGHT * meaning + HEADER_WEIGHT * head)), 4)
    if sure < LOW:
        reasons.append("validator_confidence_low")
    return name, dtype, round(fits, 4), meaning, head, sure, ",".join(dict.fromkeys(reasons))
