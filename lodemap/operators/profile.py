"""Column profiles: null rates, top values, format signatures, samples, numeric statistics, hints."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import signature
from ..sources.shared import written
from .ordering import quantiles, ranked
from .values import column_stats, value_counts

TOP, SAMPLES, OUTLIERS = 5, 5, 2


def nulls_and_distinct(counts: DataFrame) -> DataFrame:
    """(tab, col, total, nonnull, distinct_values, null_rate) from value counts."""
    s = column_stats(counts)
    return s.select(
        "tab", "col", "total", "nonnull", F.col("distinct").alias("distinct_values"),
        F.when(F.col("total") > 0, F.round((F.col("total") - F.col("nonnull")) / F.col("total"), 4)).otherwise(0.0).alias("null_rate"),
    )


def numeric_stats(df: DataFrame, columns: list[str], name: str = "") -> DataFrame:
    """(tab, col, minimum, maximum, mean, std, p05, p25, p50, p75, p95): exact, population deviation, all columns together."""
    shares = (0.05, 0.25, 0.5, 0.75, 0.95)
    cells = [F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns]
    rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.col", "c.x").where("x is not null and not isnan(x)")
    out = rows.groupBy("col").agg(
        F.min("x").alias("minimum"), F.max("x").alias("maximum"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")
    ).join(quantiles(rows, "x", shares, ["col"]), "col")
    numbers = ["minimum", "maximum", "mean", "std"]
    return out.select(
        F.lit(name).alias("tab"), "col", *[six_digits(F.col(c)).alias(c) for c in numbers], *[six_digits(F.col("q")[i]).alias(f"p{round(100 * s):02d}") for i, s in enumerate(shares)]
    )


@F.pandas_udf(DoubleType())
def six_digits(x: pd.Series) -> pd.Series:
    """Whole numbers as they are, others with six significant digits of their exact value; for the one row a column has."""
    return pd.Series([v if v != v or v == math.floor(v) else float(f"{v:.6g}") for v in x], dtype="float64")


def top_values(counts: DataFrame, k: int = TOP) -> DataFrame:
    """(tab, col, value, n, rate, rank): most frequent values, ties by value; the rate is over all rows, nulls too."""
    order = Window.partitionBy("tab", "col").orderBy(F.desc("n"), "value")
    sums = counts.groupBy("tab", "col").agg(F.sum("n").alias("total"))
    best = counts.where("value is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(F.broadcast(sums), ["tab", "col"]).select("tab", "col", "value", "n", F.round(F.col("n") / F.col("total"), 4).alias("rate"), "rank")


def signatures(counts: DataFrame) -> DataFrame:
    """(tab, col, signature, n, coverage): the most frequent format of each column and the share of non-null values that have it."""
    by = counts.where("value is not null").groupBy("tab", "col", signature(F.col("value")).alias("signature")).agg(F.sum("n").alias("n"))
    sums = by.groupBy("tab", "col").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("tab", "col").orderBy(F.desc("n"), "signature")
    best = by.withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.join(F.broadcast(sums), ["tab", "col"]).select("tab", "col", "signature", "n", F.round(F.col("n") / F.col("total"), 4).alias("coverage"))


def signature_outliers(counts: DataFrame, k: int = OUTLIERS) -> DataFrame:
    """(tab, col, value, rank): the shortest values of another format than the column's dominant one."""
    best = signatures(counts).select("tab", "col", F.col("signature").alias("main"))
    other = counts.where("value is not null").join(F.broadcast(best), ["tab", "col"]).where(signature(F.col("value")) != F.col("main"))
    order = Window.partitionBy("tab", "col").orderBy(F.length("value"), "value")
    return other.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("tab", "col", "value", "rank")


def samples(counts: DataFrame, k: int = SAMPLES) -> DataFrame:
    """(tab, col, value, place): k values spread evenly over the distinct ones in order of (length, value)."""
    values = counts.where("value is not null").select("tab", "col", "value", F.length("value").alias("size"))
    ranks = ranked(values, ["size", "value"], ["tab", "col"], "rn").withColumnRenamed("_total", "total")
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("total") - 1) / (k - 1)))
    wanted = F.when(F.col("total") <= k, F.col("rn")).otherwise(F.array_position(picks, F.col("rn")) - 1)
    return ranks.withColumn("place", wanted).where("place >= 0").select("tab", "col", "value", F.col("place").cast("int").alias("place"))


def hints(counts: DataFrame) -> DataFrame:
    """(tab, col, hints string): all_null, mostly_null, constant, high_cardinality, identifier_like; comma-joined in this order."""
    s = nulls_and_distinct(counts)
    rate, ratio = F.col("null_rate"), F.col("distinct_values") / F.greatest(F.col("nonnull"), F.lit(1))
    return s.select(
        "tab",
        "col",
        F.array_join(
            F.array_compact(
                F.array(
                    F.when((F.col("total") > 0) & (F.col("nonnull") == 0), "all_null"),
                    F.when((rate >= 0.5) & (F.col("nonnull") > 0), "mostly_null"),
                    F.when(F.col("distinct_values") == 1, "constant"),
                    F.when((F.col("nonnull") > 0) & (ratio >= 0.95), "high_cardinality"),
                    F.when(F.lower("col").rlike("(^|_)(id|key|code|no|number)$|(id|key)$"), "identifier_like"),
                )
            ),
            ",",
        ).alias("hints"),
    )


def temporal_ranges(df: DataFrame, columns: list[str], name: str = "") -> DataFrame:
    """(tab, col, earliest, latest string, parsed long) of date and time columns."""
    cells = [F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("timestamp_ntz").alias("t")) for c in columns]
    rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.col", "c.t")
    show = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return rows.groupBy("col").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("t").alias("parsed")).select(
        F.lit(name).alias("tab"), "col", show("a").alias("earliest"), show("b").alias("latest"), "parsed"
    )


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a column: (tab, col, total, nonnull, distinct_values, null_rate, signature, coverage, top, hints)."""
    counts = written(value_counts(tables), "value-counts")
    top = top_values(counts).groupBy("tab", "col").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
    keys = ["tab", "col"]
    return nulls_and_distinct(counts).join(signatures(counts).drop("n"), keys, "left").join(top, keys, "left").join(hints(counts), keys)
