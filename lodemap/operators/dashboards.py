"""Dashboards of organisations: figures of each active member, totals of each organisation and of all.

A fact is a row with its organisation and user.  All fact tables go through one
grouping: each gives narrow rows (org, user, measure, amount), which are added up
by user before the only shuffle, so a user with a third of all rows is no hot key.
Totals are sums of those sums; a mean is kept as a sum and a count until the end.

An organisation's totals count all its facts, also those of users who left or are
unknown (null), except for measures that are of active members only.  Without facts
counts and sums are 0 and means null.  Null moments are in no month; null amounts
count for no mean and add nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: how many events of an organisation a dashboard lists.
SHOWN = 50
COUNT, SUM, MEAN = "count", "sum", "mean"


@dataclass(frozen=True)
class Measure:
    """What is counted, added up or averaged of the rows of a fact table with columns ``org`` and ``user``.

    With a ``moment`` only rows of the dashboard's month count.
    """

    name: str
    rows: DataFrame
    kind: str = COUNT
    amount: str | None = None
    moment: str | None = None
    members_only: bool = False


def in_month(moment: Column, month: str) -> Column:
    """Whether a moment lies in a month such as 2024-01; two comparisons that reach the scan."""
    first = F.to_date(F.lit(f"{month}-01"))
    return (moment >= first) & (moment < F.add_months(first, 1))


def sums(measures: list[Measure], month: str) -> DataFrame:
    """(org, user, <name>, <name>_n for each measure): sums and numbers of amounts, by user."""
    parts = []
    for m in measures:
        rows = m.rows if m.moment is None else m.rows.where(in_month(F.col(m.moment), month))
        amount = F.lit(1.0) if m.kind == COUNT else F.col(m.amount).cast("double")
        parts.append(rows.select("org", "user", F.lit(m.name).alias("measure"), amount.alias("amount")))
    flat = reduce(DataFrame.unionByName, parts)
    own = lambda m: F.when(F.col("measure") == m.name, F.col("amount"))
    return flat.groupBy("org", "user").agg(*[x for m in measures for x in (F.sum(own(m)).alias(m.name), F.count(own(m)).alias(f"{m.name}_n"))])


def shown(m: Measure) -> Column:
    if m.kind == MEAN:
        return F.when(F.col(f"{m.name}_n") > 0, F.col(m.name) / F.col(f"{m.name}_n")).alias(m.name)
    whole = F.coalesce(F.col(m.name), F.lit(0.0))
    return (whole.cast("long") if m.kind == COUNT else whole).alias(m.name)


def users(members: DataFrame, measures: list[Measure], month: str) -> DataFrame:
    """A row for each active member with all its columns but ``active``, and its measures."""
    active = members.where("active").drop("active")
    return active.join(sums(measures, month), ["org", "user"], "left").select(*active.columns, *[shown(m) for m in measures])


def totals(members: DataFrame, measures: list[Measure], month: str) -> DataFrame:
    """(org, every boolean, users long, the measures) of each organisation and, where ``every``, of all."""
    each = members.select("org", "user", F.coalesce("active", F.lit(False)).alias("active")).distinct()
    both = each.join(sums(measures, month), ["org", "user"], "full").withColumn("active", F.coalesce("active", F.lit(False)))
    adds = []
    for m in measures:
        for c in (m.name, f"{m.name}_n"):
            adds.append(F.sum(F.when(F.col("active"), F.col(c)) if m.members_only else F.col(c)).alias(c))
    out = both.rollup("org").agg(F.grouping("org").alias("every"), F.count_if("active").alias("users"), *adds)
    return out.select("org", (F.col("every") == 1).alias("every"), "users", *[shown(m) for m in measures])


def recent(events: DataFrame, ident: str, moment: str, shown: int = SHOWN) -> DataFrame:
    """The latest events of each organisation, ranked from 1; no task gets more than its shown rows of a partition."""
    order = Window.partitionBy("org").orderBy(F.desc_nulls_last(moment), F.desc(ident))
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)
