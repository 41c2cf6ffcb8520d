"""Queries of joins, sets, windows, pivots and chart shapes, as analysts write them on the approved tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relate, widgets
from .registry import query, table


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _join(how: str):
    def run(spark, sf_dir):
        """All customers with all events of theirs; most customers have none."""
        c = _customers(spark, sf_dir).select("c_custkey", "c_mktsegment")
        e = table(spark, sf_dir, "events").select("event_id", "user_id")
        return c.join(e, F.col("c_custkey") == F.col("user_id"), how)

    return run


for _how, _word in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN"), ("semi", "SEMI JOIN"), ("anti", "ANTI JOIN")):
    _run = _join({"semi": "left_semi", "anti": "left_anti"}.get(_how, _how))
    _run.__name__ = f"join_{_how}"
    _cols = "c_custkey, c_mktsegment" + ("" if _how in ("semi", "anti") else ", event_id, user_id")
    query(f"SELECT {_cols} FROM customer c {_word} events e ON c_custkey = user_id")(_run)


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, sf_dir):
    """Two tables of fixed size (nations and regions): the one case a product is for."""
    return table(spark, sf_dir, "nation").select("n_name").crossJoin(F.broadcast(table(spark, sf_dir, "region").select("r_name")))


@query("SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("n1"), F.col("b.n_name").alias("n2"))


@query("""SELECT r_name, c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def join_by_links(spark, sf_dir):
    """Orders up to regions along many-to-one links: each link joins a child to its parent; orders are summed by customer first."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    held = {"orders": o, "customer": table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "nation": table(spark, sf_dir, "nation"), "region": table(spark, sf_dir, "region")}
    path = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]
    for a, col_a, b, col_b in path:
        held[b] = relate.join_by_link({a: held[a], b: held[b]}, {"tab_a": a, "col_a": col_a, "tab_b": b, "col_b": col_b}, "inner")
    return held["region"].groupBy("r_name", "c_mktsegment").agg(F.sum("n").alias("n_orders"), F.round(F.sum("v"), 2).alias("revenue"))


def _sets(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))


_A, _B = "SELECT c_custkey AS k FROM customer", "SELECT user_id AS k FROM events"


@query(f"{_A} UNION ALL {_B}")
def set_union_all(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.unionByName(b)


@query(f"{_A} UNION {_B}")
def set_union_distinct(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.unionByName(b).distinct()


@query(f"{_A} INTERSECT {_B}")
def set_intersect(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.intersect(b)


@query(f"{_A} EXCEPT {_B}")
def set_except(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.subtract(b)


@query("""SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS price_rank, CAST(dense_rank() OVER w AS INTEGER) AS price_dense, round(percent_rank() OVER w, 6) AS price_percent
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)""")
def window_rank(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return _orders(spark, sf_dir).select("o_orderkey", F.rank().over(w).alias("price_rank"), F.dense_rank().over(w).alias("price_dense"), F.round(F.percent_rank().over(w), 6).alias("price_percent"))


@query("""SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS diff,
round(o_totalprice / lag(o_totalprice) OVER w - 1, 6) AS pct_change FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_shift(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x, before = F.col("o_totalprice"), F.lag("o_totalprice").over(w)
    return _orders(spark, sf_dir).select("o_orderkey", before.alias("before"), F.lead(x).over(w).alias("after"), F.round(x - before, 4).alias("diff"), F.round(x / before - 1, 6).alias("pct_change"))


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS cumsum, round(avg(o_totalprice) OVER (w ROWS 2 PRECEDING), 4) AS rolling,
count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS expanding FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_running(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    so_far, three = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-2, 0)
    return _orders(spark, sf_dir).select(
        "o_orderkey", F.round(F.sum("o_totalprice").over(so_far), 2).alias("cumsum"), F.round(F.avg("o_totalprice").over(three), 4).alias("rolling"), F.count("*").over(so_far).alias("expanding")
    )


@query("SELECT o_custkey, max(struct_pack(d := o_orderdate, k := o_orderkey)).k AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_per_key(spark, sf_dir):
    """The latest row of each key by an aggregate, which combines before the shuffle, instead of a window."""
    return _orders(spark, sf_dir).groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def group_rollup(spark, sf_dir):
    return _orders(spark, sf_dir).rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def group_cube(spark, sf_dir):
    return _orders(spark, sf_dir).cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(o_orderpriority, 'All') AS o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o,
count(*) FILTER (o_orderstatus = 'P') AS p, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def crosstab_margins(spark, sf_dir):
    return widgets.crosstab(_orders(spark, sf_dir), "o_orderpriority", "o_orderstatus", {"F": "f", "O": "o", "P": "p"})


@query("""SELECT CASE WHEN o_totalprice <= 1000 THEN 'low' WHEN o_totalprice <= 100000 THEN 'middle' ELSE 'high' END AS class, count(*) AS n FROM orders GROUP BY 1""")
def cut_bins(spark, sf_dir):
    x = F.col("o_totalprice")
    return _orders(spark, sf_dir).groupBy(F.when(x <= 1000, "low").when(x <= 100000, "middle").otherwise("high").alias("class")).agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)
SELECT CAST(CASE WHEN o_totalprice <= a THEN 0 WHEN o_totalprice <= b THEN 1 WHEN o_totalprice <= c THEN 2 ELSE 3 END AS INTEGER) AS quarter, count(*) AS n FROM orders, q GROUP BY 1""")
def qcut_bins(spark, sf_dir):
    return widgets.quantile_bins(_orders(spark, sf_dir), "o_totalprice", 4, "quarter").groupBy("quarter").agg(F.count("*").alias("n"))


@query("""SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS base FROM lineitem""")
def line_fit(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("base")
    )


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT unnest(range(0, 12)) AS bin),
h AS (SELECT least(11, CAST(floor((o_totalprice - lo) / ((hi - lo) / 12)) AS BIGINT)) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * (hi - lo) / 12, 4) AS low, round(lo + (b.bin + 1) * (hi - lo) / 12, 4) AS high, coalesce(n, 0) AS n FROM b CROSS JOIN e LEFT JOIN h USING (bin)""")
def widget_histogram(spark, sf_dir):
    return widgets.histogram(_orders(spark, sf_dir), "o_totalprice")


@query("SELECT o_orderpriority AS grp, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS q2, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS high FROM orders GROUP BY 1")
def widget_boxplot(spark, sf_dir):
    return widgets.five_numbers(_orders(spark, sf_dir), "o_orderpriority", "o_totalprice")


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS label, sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END) AS value FROM orders GROUP BY 1),
r AS (SELECT label, value, sum(value) OVER (ORDER BY label ROWS UNBOUNDED PRECEDING) AS total FROM m)
SELECT label, round(value, 2) AS value, round(CASE WHEN value >= 0 THEN total - value ELSE total END, 2) AS base, round(total, 2) AS total FROM r""")
def widget_waterfall(spark, sf_dir):
    signed = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    months = _orders(spark, sf_dir).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("label")).agg(F.sum(signed).alias("value"))
    return widgets.waterfall(months, "label", "value")


@query("""SELECT c_mktsegment AS y, o_orderpriority AS x, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS row, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS col, count(*) AS value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def widget_heatmap(spark, sf_dir):
    o = _orders(spark, sf_dir).join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return widgets.heatmap(o.groupBy(F.col("c_mktsegment").alias("y"), F.col("o_orderpriority").alias("x")).agg(F.count("*").alias("value")))


@query("""SELECT o_orderpriority AS category, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2), 0) AS f, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2), 0) AS o,
coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2), 0) AS p FROM orders GROUP BY 1""")
def widget_pivot(spark, sf_dir):
    return widgets.series(_orders(spark, sf_dir), "o_orderpriority", "o_orderstatus", "o_totalprice", {"F": "f", "O": "o", "P": "p"})


@query("SELECT c_mktsegment AS source, o_orderpriority AS target, count(*) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def widget_sankey(spark, sf_dir):
    o = _orders(spark, sf_dir).join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("source"), F.col("o_orderpriority").alias("target")).agg(F.count("*").alias("value"))


@query("SELECT p_brand AS label, count(*) AS value, CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS INTEGER) AS place FROM part GROUP BY 1 QUALIFY place <= 10")
def widget_top_n(spark, sf_dir):
    return widgets.top_n(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("value")), 10)


@query("""SELECT event_id, event_type AS grp, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS lane, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events""")
def widget_timeline(spark, sf_dir):
    return widgets.timeline(table(spark, sf_dir, "events"), "event_id", "event_type", "ts")
