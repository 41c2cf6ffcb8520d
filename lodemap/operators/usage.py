"""Usage ledgers: rollups, limits, dashboards and gaps between kept events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_MINUTES = 10


def daily(events: DataFrame, keys: list[str], amount: str, moment: str = "ts") -> DataFrame:
    """(day, keys, n, total): additive, so that rollups of parts add up to that of the whole."""
    return events.groupBy(F.to_date(moment).alias("day"), *keys).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Two daily rollups added up: an upsert without updates."""
    return old.unionByName(new).groupBy("day", *keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def cap(limit: Column, percent: Column) -> Column:
    """The hard limit: a share of the limit, never below 0."""
    return F.greatest(F.lit(0), F.floor(limit * percent / 100))


def spaced(events: DataFrame, user: str = "user_id", moment: str = "ts", ident: str = "event_id", minutes: int = GAP_MINUTES) -> DataFrame:
    """The events that come at least ``minutes`` after the last kept one of the same user: (user, ident).

    Which one is kept depends on those kept before, so events are gone through in
    order.  An event at least ``minutes`` after the one before is always kept, so a
    user's events are cut there and each stretch is gone through on its own: the
    first and last event of each grid cell of ``minutes`` show where, and there is
    no gap inside a cell.  Stretches arrive sorted in Arrow batches and only the
    last kept moment is held, so that a long one needs no more memory.
    """
    kinds = dict(events.dtypes)
    step = pd.Timedelta(minutes=minutes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, last = object(), None
        for batch in batches:
            keep = []
            for u, s, t in zip(batch["u"], batch["s"], batch["t"]):
                if (u, s) != who or t - last >= step:
                    who, last = (u, s), t
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch.loc[keep, ["u", "i"]].rename(columns={"u": user, "i": ident})

    rows = events.where(F.col(user).isNotNull() & F.col(moment).isNotNull()).select(F.col(user).alias("u"), F.col(moment).alias("t"), F.col(ident).alias("i"))
    rows = rows.withColumn("g", F.window("t", f"{minutes} minutes")["start"])
    order = Window.partitionBy("u").orderBy("g")
    cells = rows.groupBy("u", "g").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    cut = F.col("first") - F.lag("last").over(order) >= F.make_dt_interval(mins=F.lit(minutes))
    stretches = cells.withColumn("cut", cut.cast("int")).select("u", "g", F.coalesce(F.sum("cut").over(order), F.lit(0)).alias("s"))
    placed = rows.join(stretches, ["u", "g"]).select("u", "s", "t", "i").repartition("u", "s").sortWithinPartitions("u", "s", "t", "i")
    return placed.mapInPandas(run, f"`{user}` {kinds[user]}, `{ident}` {kinds[ident]}")
