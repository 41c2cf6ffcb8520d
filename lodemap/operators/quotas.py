"""Quota checks: what users and their organisations have used against their hard limits, and whether one more thing fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .usage import cap

#: The kinds of quota. Counted ones are full at their cap, amounts when what is asked for goes beyond it, and a file stands for itself.
COUNTED, AMOUNTS, SINGLE = ("sessions", "jobs"), ("storage", "upload", "tokens"), ("file_size",)


def used_by(rows: DataFrame, kind: str, amount: Column | None = None, org: str = "org", user: str = "user") -> DataFrame:
    """(org, user, kind, used): rows counted, or an amount added up, by user."""
    used = F.count("*") if amount is None else F.coalesce(F.sum(amount), F.lit(0))
    return rows.groupBy(F.col(org).alias("org"), F.col(user).alias("user")).agg(used.cast("double").alias("used")).withColumn("kind", F.lit(kind))


def checks(used: list[DataFrame], limits: DataFrame, asked: dict[str, float] | None = None, percent: float = 100.0) -> DataFrame:
    """(org, user, kind, scope, used, cap, refused) of every user, for each limit that holds for it.

    ``limits`` has (org, user, kind, limit); a null user is the organisation's own
    limit, whose use is that of all its users.  ``asked`` is what one more thing of a
    kind would need.  Without a limit there is no row.  Uses are summed by user, then by organisation: no join sees single events.
    """
    both = reduce(DataFrame.unionByName, [u.select("org", "user", "kind", "used") for u in used])
    own = both.groupBy("org", "user", "kind").agg(F.sum("used").alias("used"))
    whole = own.groupBy("org", "kind").agg(F.sum("used").alias("all_used"))
    limit = F.col("limit")
    of_user = limits.where("user is not null").select("org", "user", "kind", limit.alias("user_limit"))
    of_org = limits.where("user is null").groupBy("org", "kind").agg(F.min("limit").alias("org_limit"))
    rows = own.join(of_user, ["org", "user", "kind"], "left").join(whole, ["org", "kind"]).join(of_org, ["org", "kind"], "left")
    scopes = F.inline(F.array(*[F.struct(F.lit(s).alias("scope"), F.col(u).alias("spent"), F.col(c).alias("limit")) for s, u, c in (("user", "used", "user_limit"), ("organization", "all_used", "org_limit"))]))
    flat = rows.select("org", "user", "kind", scopes).where("limit is not null")
    most = cap(limit, F.lit(percent)).cast("double")
    need = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (asked or {"": 0.0}).items() for x in (kv[0], float(kv[1]))]), F.col("kind")), F.lit(0.0))
    full = F.when(F.col("kind").isin(*COUNTED), F.col("spent") >= most).when(F.col("kind").isin(*SINGLE), need > most).otherwise(F.col("spent") + need > most)
    return flat.select("org", "user", "kind", "scope", F.round("spent", 2).alias("used"), most.alias("cap"), full.alias("refused"))
