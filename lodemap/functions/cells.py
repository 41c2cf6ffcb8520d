"""Cells to typed values: numbers, dates, booleans, and the votes by which a column gets its type.

A column's type depends on all its values.  ``votes`` counts, for every column at
once, how many values each reading accepts (one job, partial aggregates); the
driver decides on those few counts; ``cast_columns`` is then one projection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .natural import in_words, natural_date
from .text import CURRENCY, NULL_TOKENS, squeezed, without_mojibake

# Readings of dates that are tried, in the order in which ties are kept.
DATE_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy", "d.M.yyyy", "M.d.yyyy", "d/M/yy", "M/d/yy", "d-M-yy", "M-d-yy", "d.M.yy", "M.d.yy",
    "yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "d/M/yyyy H:m:s", "M/d/yyyy H:m:s", "d-M-yyyy H:m:s", "M-d-yyyy H:m:s",
)
#: Readings that are tried if none of these reads any value.
OTHER_FORMATS = (
    "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m", "d/M/yyyy H:m", "d-MMM-yyyy", "d-MMM-yy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd",
)
FORMATS = DATE_FORMATS + OTHER_FORMATS
#: The reading of dates in words, tried last of all.
NATURAL = "natural"
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "1", "t"), ("false", "no", "n", "0", "f")
#: Share of values that have to parse, and how sure a column is whose dates can be read both ways.
LEAST_SHARE, UNSURE = 0.85, 0.5
# Words of scale and their factors.
SCALES = {
    "thousand": 1e3, "thousands": 1e3, "k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "crore": 1e7, "crores": 1e7,
    "million": 1e6, "millions": 1e6, "billion": 1e9, "billions": 1e9,
}
ALIASES = {
    "integer": "int", "int64": "int", "long": "int", "number": "float", "numeric": "float", "float64": "float", "double": "float", "decimal": "float",
    "timestamp": "datetime", "boolean": "bool", "categorical": "category",
}
DTYPES = ("string", "int", "float", "date", "datetime", "bool", "category")


def dtype_of(name: str) -> str:
    """A logical type for a declared one; unknown ones are strings."""
    low = name.strip().lower()
    found = ALIASES.get(low, low)
    return found if found in DTYPES else "string"


def clean_cell(cell: Column) -> Column:
    """Mojibake repaired, trimmed, null words to null."""
    value = F.trim(without_mojibake(cell))
    return F.when(~value.isin(*NULL_TOKENS), value)


def bare(cell: Column) -> Column:
    """A cell without currency marks and blanks; most hold neither, and one test spares them the two passes."""
    return F.when(cell.rlike(r"^[0-9.,()+-]*\z"), cell).otherwise(F.regexp_replace(F.regexp_replace(cell, CURRENCY, ""), r"[\s\xa0 ]", ""))


def bare_number(text: Column, decimal_comma: Column | bool = False) -> Column:
    """A number in a ``bare`` cell: grouping, ``(x)`` as negative; null if there is none."""
    negative = F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")"))
    inner = F.when(negative, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    comma = F.lit(decimal_comma) if isinstance(decimal_comma, bool) else decimal_comma
    plain = F.replace(inner, F.lit(","), F.when(comma, F.lit(".")).otherwise(F.lit("")))
    number = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
    return number * F.when(negative, -1.0).otherwise(1.0)


def to_number(cell: Column, decimal_comma: Column | bool = False) -> Column:
    """A number in a cell: currency marks, grouping, ``(x)`` as negative; null if there is none."""
    return bare_number(bare(cell), decimal_comma)


def to_bool(cell: Column) -> Column:
    low = F.lower(F.trim(cell))
    return F.when(low.isin(*TRUE_WORDS), F.lit(True)).when(low.isin(*FALSE_WORDS), F.lit(False))


def shape(layout: str) -> str:
    """A pattern of what a reading can read, so that a cell is parsed only where it may succeed."""
    parts = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": r"\p{L}+", "MMM": r"\p{L}+", "MM": r"\d{2}", "dd": r"\d{2}"}
    return "^" + re.sub(r"y+|M+|d+|[Hms]|'T'|\.", lambda m: {"'T'": "T", ".": r"\."}.get(m[0], parts.get(m[0], r"\d{1,2}")), layout) + "$"


def to_time(cell: Column, layout: str) -> Column:
    """A moment by one reading; years of two digits are from 1969 to 2068."""
    moment = F.when(cell.rlike(shape(layout)), F.try_to_timestamp(cell, F.lit(layout))).cast("timestamp_ntz")
    if re.search(r"(?<!y)yy(?!y)", layout):
        moment = F.when(F.year(moment) >= 2069, moment - F.expr("interval 100 years")).otherwise(moment)
    return moment


def iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def as_text(value: Column, kind: str) -> Column:
    """A typed value as a cell: whole floats without fraction, TRUE and FALSE, NaN as null."""
    if kind == "boolean":
        return F.upper(value.cast("string"))
    if kind in ("double", "float"):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(~F.isnan(value), F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string")))
    return value.cast("string")


@dataclass(frozen=True)
class Vote:
    """What a column is taken for: kind, the reading of its dates, whether commas are decimal, and how sure that is."""

    kind: str
    layout: str | None = None
    decimal_comma: bool = False
    confidence: float = 1.0
    reasons: tuple[str, ...] = ()


def _masks(layout: str) -> list[str]:
    """What cells of a reading without names of months look like, each digit as D."""
    out = [""]
    for part in re.findall(r"y+|M+|d+|[Hms]|'T'|.", layout):
        if part[0] in "yMdHms":
            sizes = (len(part),) if part[0] == "y" or len(part) > 1 else (1, 2)
            out = [o + "D" * n for o in out for n in sizes]
        else:
            out = [o + part.strip("'") for o in out]
    return out


#: Readings by mask; those with names of months are parsed.
NAMED = tuple(f for f in FORMATS if "MMM" in f)
MASKS: dict[str, list[str]] = {}
for _f in FORMATS:
    for _m in _masks(_f) if _f not in NAMED else ():
        MASKS.setdefault(_m, []).append(_f)


def _is_day(year: Column, month: Column, day: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return month.between(1, 12) & (day >= 1) & (day <= last)


def _order(layout: str) -> str:
    """Of year, month and day: ymd, dmy or mdy."""
    return "".join(sorted("ymd", key=lambda c: layout.replace("m", "").lower().index(c)))


def count_readings(df: DataFrame, columns: list[str]) -> dict[str, dict[str, int]]:
    """For each column how many cells there are (``n``), and how many each reading accepts.

    A cell is cleaned once.  Dates in digits are told by the cell's mask and by whether
    its numbers are a day and a time in any order, without parsing it once a reading.
    Cells are counted by mask and marks, of which there are few, in one grouping.
    """
    cells = [F.struct(F.lit(i).alias("col"), F.col(f"`{c}`").cast("string").alias("cell")) for i, c in enumerate(columns)]
    rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.col", clean_cell(F.col("c.cell")).alias("cell")).where("cell is not null")
    cell, mask = F.col("cell"), F.translate("cell", "0123456789D", "DDDDDDDDDDx")
    rows = rows.select("col", "cell", F.when(mask.isin(*MASKS), mask).alias("mask"), cell.rlike(r"\p{L}").alias("lettered"), F.contains(cell, F.lit(",")).alias("comma"), bare(cell).alias("bare"))
    rows = rows.select("*", bare_number(F.col("bare")).alias("number"), F.when(F.col("comma"), bare_number(F.col("bare"), True)).alias("number2"))
    dated = F.when(_mask_is("DDDDDDDD"), F.concat_ws(" ", F.substring("cell", 1, 4), F.substring("cell", 5, 2), F.substring("cell", 7, 2))).otherwise(F.translate("cell", "-/.T:", "     "))
    rows = rows.select("*", F.when(F.col("mask").isNotNull(), F.split(dated, " ")).alias("parts"))
    part = lambda k, other=None: F.coalesce(F.get("parts", F.lit(k)).try_cast("int"), F.lit(other))
    rows = rows.select("*", *[part(k).alias(f"p{k}") for k in range(3)], ((part(3, 0) < 24) & (part(4, 0) < 60) & (part(5, 0) < 60)).alias("timed"))
    year = lambda c: F.when(F.length(F.get("parts", F.lit(int(c[1])))) == 2, F.col(c) + 2000).otherwise(F.col(c))
    marks = {order: F.col("mask").isNotNull() & F.col("timed") & _is_day(year(f"p{order.index('y')}"), F.col(f"p{order.index('m')}"), F.col(f"p{order.index('d')}")) for order in ("ymd", "dmy", "mdy")}
    comma_number = F.when(F.col("comma"), F.col("number2")).otherwise(F.col("number"))
    with_comma = F.col("comma") & ~F.contains(cell, F.lit("."))
    marks |= {
        "number": F.col("number").isNotNull(),
        "whole": F.col("number") == F.floor("number"),
        "whole_comma": comma_number == F.floor(comma_number),
        "with_comma": with_comma,
        "comma_style": with_comma & cell.rlike(r"^[+-]?\d+,\d{1,2}$"),
        "bool": to_bool(cell).isNotNull(),
        "worded": F.col("lettered") & in_words(cell),
    }
    marks |= {f"date{FORMATS.index(f)}": F.col("lettered") & to_time(cell, f).isNotNull() for f in NAMED}
    told = rows.groupBy("col", "mask", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in marks.items()]).agg(F.count("*").alias("n"))
    out = {c: dict.fromkeys(["n", *list(marks)[3:], *[f"date{i}" for i in range(len(FORMATS))]], 0) for c in columns}
    for r in told.collect():  # a row for each mask and set of marks
        counts = out[columns[r["col"]]]
        for k in ["n", *list(marks)[3:]]:
            counts[k] += r["n"] if k == "n" or r[k] else 0
        for f in MASKS.get(r["mask"], ()):
            counts[f"date{FORMATS.index(f)}"] += r["n"] if r[_order(f)] else 0
    return out


def _mask_is(mask: str) -> Column:
    return F.coalesce(F.col("mask") == mask, F.lit(False))


def decide(counts: dict[str, int], least: float = LEAST_SHARE) -> Vote:
    """A column's type from its counts: numbers first, then dates if one reading is ahead of all others, else text."""
    n = counts["n"]
    if not n:
        return Vote("string", confidence=0.65, reasons=("all_null",))
    if counts["number"] / n >= least:
        comma = counts["with_comma"] > 0 and counts["with_comma"] == counts["comma_style"]
        whole = counts["whole_comma" if comma else "whole"]
        return Vote("int" if whole == counts["number"] else "float", decimal_comma=comma, confidence=counts["number"] / n)
    read = {f: counts[f"date{i}"] for i, f in enumerate(FORMATS)}
    main = {f: read[f] for f in DATE_FORMATS}
    if not any(main.values()):
        best = max(OTHER_FORMATS, key=read.get)
        if read[best] / n >= least:
            return Vote("datetime", best, confidence=read[best] / n)
        return Vote("datetime", NATURAL, confidence=counts["natural"] / n) if counts.get("natural", 0) / n >= least else Vote("string")
    best = max(main, key=main.get)
    if main[best] == sorted(main.values())[-2]:
        return Vote("string", confidence=UNSURE, reasons=("ambiguous_date_format",))
    return Vote("datetime", best, confidence=main[best] / n) if main[best] / n >= least else Vote("string")


def votes(df: DataFrame, columns: list[str] | None = None, least: float = LEAST_SHARE) -> dict[str, Vote]:
    """The type of every column, by one aggregate over all rows; dates in words are read in another, of the columns that look like them."""
    columns = columns or df.columns
    counts = count_readings(df, columns)
    asked = [c for c in columns if counts[c]["n"] and counts[c]["worded"] / counts[c]["n"] >= least]
    if asked:
        read = df.agg(*[F.count(natural_date(clean_cell(F.col(f"`{c}`")), F.current_timestamp())).alias(c) for c in asked]).first()
        for c in asked:
            counts[c]["natural"] = read[c]
    return {c: decide(counts[c], least) for c in columns}


def cast_cell(cell: Column, dtype: str, vote: Vote | None = None) -> Column:
    """A cell in its logical type; what can't be read is null."""
    value = clean_cell(cell)
    return cast_clean(value, bare(value), dtype, vote)


def cast_clean(value: Column, text: Column, dtype: str, vote: Vote | None = None) -> Column:
    """The same of a clean cell; ``text`` is what ``bare`` makes of it, for numbers."""
    dtype = dtype_of(dtype)
    if dtype in ("int", "float"):
        number = bare_number(text, bool(vote and vote.decimal_comma))
        return F.when(number == F.floor(number), number.cast("long")) if dtype == "int" else number
    if dtype == "bool":
        return to_bool(value)
    if dtype in ("date", "datetime"):
        layouts = [vote.layout] if vote and vote.layout else [f for f in FORMATS if f[:2] not in ("M/", "M-", "M.")]
        moment = F.coalesce(*[natural_date(value, F.current_timestamp()) if f == NATURAL else to_time(value, f) for f in layouts])
        return moment.cast("date") if dtype == "date" else moment
    return value


def cast_columns(df: DataFrame, dtypes: dict[str, str], found: dict[str, Vote] | None = None) -> DataFrame:
    """All named columns cast in one projection; others stay."""
    found = found or {}
    return df.select(*[cast_cell(F.col(f"`{c}`"), dtypes[c], found.get(c)).alias(c) if c in dtypes else F.col(f"`{c}`") for c in df.columns])


def scaled(value: Column, factor: float, whole: bool) -> Column:
    """``value * factor``; whole numbers by whole factors stay whole."""
    out = value * F.lit(float(factor))
    return F.bround(out).cast("long") if whole and float(factor).is_integer() else out


def scale_factor(word: str) -> float | None:
    """Factor that a word such as lakh or million stands for, or a number."""
    low = squeezed_word(word)
    if low in SCALES:
        return SCALES[low]
    try:
        return float(low.replace(",", ""))
    except ValueError:
        return None


def squeezed_word(word: str) -> str:
    return " ".join(word.lower().split())


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "dataclass", "squeezed")]
