"""Ranks and exact quantiles of tables of any size: range partitions, and offsets from the counts of the partitions before.

Rows are sorted in ranges over all tasks and written once with the number of their
range and their place in it.  Counts by range and group, of which there are few, give
each range the ranks before it.  No task sorts or holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Counts by range and group are broadcast if there are at most so many.
COUNTS = 100_000
#: So many distinct values of all groups fit the buffers of one aggregate; more are dealt in ranges.
FEW = 200_000


def in_ranges(df: DataFrame, order: Sequence[Column | str], groups: Sequence[str] = ()) -> DataFrame:
    """``df`` in order of (groups, order), written, with ``_range`` and ``_place``: the row's place in its range."""
    # the upper bits of the id are the task's, which is the range's, the lower 33 count its rows
    ident = F.monotonically_increasing_id()
    sorted_rows = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    numbered = sorted_rows.select("*", F.shiftright(ident, 33).cast("int").alias("_range"), ident.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    return written(numbered, "ranges")


def _same(a: DataFrame, b: DataFrame, groups: Sequence[str]) -> Column:
    test = a["_range"] == b["_range"]
    for g in groups:
        test = test & a[g].eqNullSafe(b[g])
    return test


def ranked(df: DataFrame, order: Sequence[Column | str], groups: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """``df`` with the 0-based rank of each row in its group (null groups are one), and ``_total``, the rows of the group."""
    rows = in_ranges(df, order, groups)
    counts = rows.groupBy("_range", *groups).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    by = Window.partitionBy(*groups)  # a row for each range and group
    before = F.coalesce(F.sum("_n").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.select("*", before.alias("_before"), F.sum("_n").over(by).alias("_total")), "range-counts")
    side = F.broadcast(counts) if counts.count() <= COUNTS else counts
    held = rows.join(side, _same(rows, side, groups))
    return held.select(*[rows[c] for c in df.columns], (F.col("_before") + rows["_place"] - F.col("_first")).alias(name), "_total")


def value_counts_in_order(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, x, n, total, below) of (groups, x, n): each distinct value, how often it is there and how many rows of its group are smaller."""
    rows = in_ranges(counts, ["x"], groups)
    sums = rows.groupBy("_range", *groups).agg(F.sum("n").alias("_n"))
    by = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_n").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = written(sums.select("*", before.alias("_before"), F.sum("_n").over(by).alias("total")), "range-sums")
    side = F.broadcast(sums) if sums.count() <= COUNTS else sums
    held = rows.join(side, _same(rows, side, groups)).select(*[rows[g] for g in groups], rows["_range"], rows["_place"], "x", "n", "_before", "total")
    inside = Window.partitionBy("_range", *groups).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)  # one range, one task
    return held.select(*groups, "x", "n", "total", (F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("below"))


def quantiles(df: DataFrame, column: str, shares: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, total, q array<double>): exact quantiles, between two values in proportion.

    Values are counted before they are dealt, and of each group only the values that
    hold a wanted rank are kept.  Without rows there is no group, and no row.
    """
    counts = written(df.where(F.col(column).isNotNull()).groupBy(*groups, F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n")), "value-counts")
    if counts.count() <= FEW:
        q = F.percentile("x", [float(s) for s in shares], F.col("n"))
        return counts.groupBy(*groups).agg(F.sum("n").alias("total"), q.alias("q")).where("total is not null")
    rows = value_counts_in_order(counts, groups)
    at = [(F.col("total") - 1) * float(s) for s in shares]
    spots = [F.struct(F.lit(i).alias("i"), f(p).cast("long").alias("spot")) for i, p in enumerate(at) for f in (F.floor, F.ceil)]
    hit = F.filter(F.array(*spots), lambda s: (s["spot"] >= F.col("below")) & (s["spot"] < F.col("below") + F.col("n")))
    found = rows.select(*groups, "total", "x", F.explode(hit).alias("s")).select(*groups, "total", "x", "s.i", "s.spot").distinct()
    one = found.groupBy(*groups, "total", "i").agg(F.min_by("x", "spot").alias("low"), F.max_by("x", "spot").alias("high"))
    part = F.element_at(F.array(*at), F.col("i") + 1)
    value = F.col("low") + (F.col("high") - F.col("low")) * (part - F.floor(part))
    listed = F.sort_array(F.collect_list(F.struct("i", value.alias("v"))))
    return one.groupBy(*groups, "total").agg(listed.alias("q")).select(*groups, "total", F.transform("q", lambda s: s["v"]).alias("q"))
