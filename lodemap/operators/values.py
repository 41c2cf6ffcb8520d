"""The value kernel: (table, column, value, n), counted once for all columns of all tables.

Profiles, anomalies and join-key discovery are all answered from it, so a table is
read once and shuffled once, by value, with partial aggregates before the shuffle:
a value that a third of all rows hold is a row from each task there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import as_text


def long_form(df: DataFrame, columns: list[str] | None = None, name: str = "") -> DataFrame:
    """(tab, col, value string) of every cell."""
    kinds = dict(df.dtypes)
    columns = columns or [c for c, k in df.dtypes if not k.startswith(("array", "map", "struct"))]
    cells = [F.struct(F.lit(c).alias("col"), as_text(F.col(f"`{c}`"), kinds[c]).alias("value")) for c in columns]
    return df.select(F.lit(name).alias("tab"), F.explode(F.array(*cells)).alias("c")).select("tab", "c.col", "c.value")


def value_counts(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """(tab, col, value string, n long); a null value counts nulls."""
    out = None
    for name, df in tables.items():
        part = long_form(df, (columns or {}).get(name), name)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("tab", "col", "value").agg(F.count("*").alias("n"))


def column_stats(counts: DataFrame) -> DataFrame:
    """(tab, col, total, nonnull, distinct, avg_length): from value counts."""
    there = F.col("value").isNotNull()
    return counts.groupBy("tab", "col").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("nonnull"),
        F.count("value").alias("distinct"),
        F.avg(F.length("value")).alias("avg_length"),
    )
