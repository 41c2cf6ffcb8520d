"""Text functions as columns: signatures, display values, slugs, ratios, similarity.

Every function takes and returns columns and stays in the JVM, except
``name_similarity``, which is meant for the small table of column pairs.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# What counts as null in a cell, and marks of currency.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "#REF!", "#VALUE!", "-", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "na", "n/a", "nan", "nil", "NIL", "null", "—", "–",
)
CURRENCY = r"(?i)₹|rs\.?|inr|us\$|usd|\$|eur|€|gbp|£|aud|cad|sgd|aed|¥"


def squeezed(text: Column) -> Column:
    """Trimmed, each run of white space one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def signature(text: Column) -> Column:
    """Format signature: runs of digits D, capitals A, other letters a with their length; other signs as they are."""
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7F]|[a-z]", "a"), "[B-Z]", "A"), "[0-9]", "D")
    runs = F.regexp_extract_all(classes, F.lit("(D+|A+|a+| +|[^DAa ])"), 1)
    short = lambda t: F.when(F.length(t) > 1, F.concat(F.left(t, F.lit(1)), F.length(t).cast("string"))).otherwise(t)
    return F.array_join(F.transform(runs, short), "")


def display(text: Column) -> Column:
    """A value as reports show it: one line of at most 80 characters."""
    line = squeezed(text)
    return F.when(F.length(line) > 80, F.concat(F.left(line, F.lit(77)), F.lit("..."))).otherwise(line)


def slug(name: Column) -> Column:
    """Table name for a file stem: lower case, ``_`` for other signs, ``t_`` before a digit, ``table`` if nothing is left."""
    base = F.trim(F.lit("_"), F.lower(F.regexp_replace(name, "[^A-Za-z0-9_]+", "_")))
    return F.when(base == "", F.lit("table")).when(base.rlike("^[0-9]"), F.concat(F.lit("t_"), base)).otherwise(base)


def slug_of(name: str) -> str:
    """``slug`` for one name on the driver."""
    base = re.sub("[^A-Za-z0-9_]+", "_", name).lower().strip("_")
    return "table" if not base else f"t_{base}" if base[0].isdigit() else base


def without_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again, where the marks of it are there and all characters allow it."""
    able = text.rlike(r"[ÂÃâ][\u0080-¿]") & ~text.rlike(r"[^\x00-ÿ]")
    again = F.encode(text, "ISO-8859-1").cast("string")
    return F.when(able & F.is_valid_utf8(again), again).otherwise(text)


def normal_value(text: Column) -> Column:
    """A cell as join keys compare it: trimmed, lower, one space; null for null words and for more than 100 characters."""
    return comparable(F.lower(squeezed(text)))


def comparable(value: Column) -> Column:
    return F.when((value != "") & ~value.isin("nan", "none", "null") & (F.length(value) <= 100), value)


def words(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def share_of(text: Column, pattern: str) -> Column:
    """Share of a text's characters that match a class; 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(F.lit(0.0))


def summary(text: Column, size: int = 220) -> Column:
    """The start of a text, up to its last full sentence in ``size`` characters, else cut there."""
    line = squeezed(text)
    head = F.left(line, F.lit(size))
    stop = F.length(F.regexp_extract(head, r"^(.*[.!?])(?:\s|$)", 1))
    cut = F.when(stop > size // 2, F.left(head, stop)).otherwise(F.concat(F.rtrim(head), F.lit("...")))
    return F.when(F.length(line) <= size, line).otherwise(cut)


def grouped_number(value: Column, indian: bool = False, digits: int = 0) -> Column:
    """A number with commas, by thousands or as in India (lakh, crore)."""
    plain = F.format_number(value, digits)
    if not indian:
        return plain
    whole = F.regexp_replace(F.split_part(plain, F.lit("."), F.lit(1)), ",", "")
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(\d\d)*\d{3}$)", ",")
    return F.concat(grouped, F.regexp_extract(plain, r"(\.\d+)$", 1))


# Names that stand for a key by themselves.
KEY_TERMS = ("id", "code", "number", "no", "key")


def plain_name(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def similar_names(a: str, b: str) -> float:
    """Likeness of two column names: 0 without letters and digits, 1 if equal, at least .85 if one is a key term
    that the other ends with, at least .75 if one of them is ``id``."""
    x, y = plain_name(a), plain_name(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    score = difflib.SequenceMatcher(None, x, y).ratio()
    if any(t in (x, y) and x.endswith(t) and y.endswith(t) for t in KEY_TERMS):
        score = max(score, 0.85)
    if "id" in (x, y):
        score = max(score, 0.75)
    return score


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar_names(x, y) for x, y in zip(a, b)], dtype="float64")
