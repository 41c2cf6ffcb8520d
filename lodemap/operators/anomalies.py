"""Anomalies: robust outliers, rare values and orphan keys, as (tab, col, detector, row_id, value, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import quantiles

# Thresholds of the detectors and how many rows of each a report shows.
MAD_Z, MAD_SCALE, LEAST_VALUES, RARE, ORPHAN_SCORE, SHOWN = 3.5, 1.4826, 5, 0.01, 80.0, 100


def _rows(df: DataFrame, tab: str, col: str, detector: str) -> DataFrame:
    return df.select(F.lit(tab).alias("tab"), F.lit(col).alias("col"), F.lit(detector).alias("detector"), "row_id", F.col("value").cast("string").alias("value"), "score")


def outliers(df: DataFrame, col: str, row_id: str, tab: str = "", z: float = MAD_Z) -> DataFrame:
    """Values further than z robust deviations from the median; needs 5 values and a deviation that isn't 0."""
    x = df.select(F.col(row_id).alias("row_id"), F.col(col).cast("double").alias("value")).where("value is not null")
    mid = quantiles(x, "value", [0.5]).select(F.col("q")[0].alias("mid"), F.col("total").alias("n"))
    off = x.crossJoin(F.broadcast(mid)).withColumn("off", F.abs(F.col("value") - F.col("mid")))  # a one-row side
    mad = quantiles(off, "off", [0.5]).select(F.col("q")[0].alias("mad"))
    score = F.col("off") / (MAD_SCALE * F.col("mad"))
    found = off.crossJoin(F.broadcast(mad)).where((F.col("n") >= LEAST_VALUES) & (F.col("mad") > 0)).withColumn("z", score).where(F.col("z") > z)
    return _rows(found.withColumn("score", F.round(F.least(F.lit(100.0), F.col("z") / z * 50), 4)), tab, col, "mad")


def rare_values(df: DataFrame, col: str, row_id: str, tab: str = "", share: float = RARE) -> DataFrame:
    """Rows whose value has less than ``share`` of all rows. Only the rare values, counted first, are joined back."""
    n = df.agg(F.count("*").alias("total"))
    freq = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    rare = freq.crossJoin(F.broadcast(n)).withColumn("f", F.col("n") / F.col("total")).where(F.col("f") < share)  # a one-row side
    found = df.select(F.col(row_id).alias("row_id"), F.col(col).alias("value")).join(rare.select("value", "f"), "value")
    return _rows(found.withColumn("score", F.round(100 * (1 - F.col("f") / share), 4)), tab, col, "rare_value")


def orphans(child: DataFrame, col: str, parent: DataFrame, key: str, row_id: str, tab: str = "") -> DataFrame:
    """Rows whose non-null key isn't in the parent's. An anti join: the parent's distinct keys are all that is shuffled of it."""
    keys = parent.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("value")).distinct()
    rows = child.where(F.col(col).isNotNull()).select(F.col(row_id).alias("row_id"), F.col(col).cast("string").alias("value"))
    return _rows(rows.join(keys, "value", "left_anti").withColumn("score", F.lit(ORPHAN_SCORE)), tab, col, "orphan_key")


def first_of_each(found: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first rows, by row id, of each detector and column: what a report lists."""
    order = Window.partitionBy("tab", "col", "detector").orderBy("row_id")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= shown).drop("_r")


def worst(found: DataFrame, k: int) -> DataFrame:
    return found.orderBy(F.desc("score"), "tab", "col", "detector", "row_id").limit(k)


def detect(tables: dict[str, DataFrame], row_ids: dict[str, str], links: list[dict], shown: int | None = SHOWN) -> DataFrame:
    """All detectors over all tables: outliers of numbers, rare values of text, orphans of confirmed many-to-one links."""
    parts = []
    for tab, df in tables.items():
        keys = {row_ids[tab]} | {link["col_a"] for link in links if link["tab_a"] == tab}
        for col, kind in df.dtypes:
            if col in keys:
                continue
            if kind in ("int", "bigint", "double", "float"):
                parts.append(outliers(df, col, row_ids[tab], tab))
            elif kind in ("string", "boolean"):
                parts.append(rare_values(df, col, row_ids[tab], tab))
    for link in links:
        if link.get("direction") == "many_to_one" and link.get("confirmed"):
            parts.append(orphans(tables[link["tab_a"]], link["col_a"], tables[link["tab_b"]], link["col_b"], row_ids[link["tab_a"]], link["tab_a"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if shown is None else first_of_each(out, shown)
