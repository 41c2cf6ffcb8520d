"""Queries of chart shapes that keep the order of their rows, and of table edits that analysts write."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog, widgets
from .registry import query, table


def _cells(spark, sf_dir):
    """Orders as a chart's table: amounts as text with grouping, and words where there is none."""
    o = table(spark, sf_dir, "orders")
    amount = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.format_number("o_totalprice", 2))
    return o.select("o_orderkey", "o_orderpriority", "o_orderstatus", amount.alias("amount"))


@query("SELECT o_orderkey, o_orderpriority AS label, round(o_totalprice, 2) AS value FROM orders WHERE o_orderstatus <> 'P'")
def widget_items(spark, sf_dir):
    return widgets.items(_cells(spark, sf_dir), "o_orderpriority", "amount", "o_orderkey")


@query("SELECT o_orderkey, o_orderpriority AS label, round(o_totalprice, 2) AS value FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderkey LIMIT 10")
def widget_first_items(spark, sf_dir):
    return widgets.first_items(widget_items(spark, sf_dir), "o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 4")
def widget_cards(spark, sf_dir):
    return widgets.cards(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("""SELECT o_orderpriority AS category, CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS INTEGER) AS place,
coalesce(round(arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F'), 2), 0) AS f, coalesce(round(arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O'), 2), 0) AS o, 0.0 AS p FROM orders GROUP BY 1""")
def widget_series_first(spark, sf_dir):
    return widgets.first_match_series(_cells(spark, sf_dir), "o_orderpriority", "o_orderstatus", "amount", {"F": "f", "O": "o", "P": "p"}, "o_orderkey")


@query("""SELECT p_partkey, p_brand AS category, 'p_size' AS series, CAST(p_size AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, p_brand, 'p_retailprice', p_retailprice FROM part""")
def widget_wide_series(spark, sf_dir):
    return widgets.wide_series(table(spark, sf_dir, "part"), "p_brand", ["p_size", "p_retailprice"], "p_partkey")


@query("SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(8 AS DOUBLE) AS size, p_brand AS label FROM part")
def widget_scatter(spark, sf_dir):
    return widgets.scatter(table(spark, sf_dir, "part"), "p_size", "p_retailprice", label="p_brand")


@query("""WITH c AS (SELECT user_id, event_type, min(event_id) AS k, count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2),
x AS (SELECT event_type, row_number() OVER (ORDER BY min(k)) - 1 AS col FROM c GROUP BY 1), y AS (SELECT user_id, row_number() OVER (ORDER BY min(k)) - 1 AS row FROM c GROUP BY 1)
SELECT event_type AS x, CAST(user_id AS VARCHAR) AS y, CAST(col AS INTEGER) AS col, CAST(row AS INTEGER) AS row, CAST(n AS DOUBLE) AS value FROM c JOIN x USING (event_type) JOIN y USING (user_id)""")
def widget_heatmap_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id is not null and event_type is not null")
    cells = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("k"), F.count("*").alias("n"))
    return widgets.heatmap_cells(cells, "event_type", "user_id", "n", "k")


@query("""SELECT p_partkey, 'p_size' AS x, p_brand AS y, CAST(0 AS INTEGER) AS col, CAST(p_size AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, 'p_retailprice', p_brand, 1, p_retailprice FROM part""")
def widget_heatmap_matrix(spark, sf_dir):
    return widgets.heatmap_matrix(table(spark, sf_dir, "part"), "p_brand", ["p_size", "p_retailprice"], "p_partkey")


@query("SELECT c_mktsegment AS name FROM customer UNION SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def widget_sankey_nodes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    n = c.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return widgets.sankey(n, "c_mktsegment", "n_name", "n")[1]


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(concat_ws('|', CAST(p_partkey AS VARCHAR), p_name, p_brand)), '#2') OR contains(lower(p_name), '#2')")
def widget_table_search(spark, sf_dir):
    return widgets.matching(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "#2")


@query("SELECT least(l_partkey, l_suppkey) AS left_file, greatest(l_partkey, l_suppkey) AS right_file, count(*) AS n_links FROM lineitem GROUP BY 1, 2")
def review_link_pairs(spark, sf_dir):
    """Pairs of part and supplier as if they were linked files, whichever way round."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file_a"), F.col("l_suppkey").alias("file_b"))
    return catalog.links_by_pair(x)


_FIELDS = """WITH c AS (SELECT c_custkey AS file_id, unnest([{'name': 'c_custkey', 'dtype': 'int'}, {'name': 'nation_id', 'dtype': 'int'}, {'name': 'total', 'dtype': 'float'}, {'name': 'since', 'dtype': 'date'},
{'name': 'segment', 'dtype': 'category'}, {'name': 'name', 'dtype': 'string'}]) AS f FROM customer)
SELECT file_id, f.name AS name, f.dtype AS dtype, CAST(row_number() OVER (PARTITION BY file_id ORDER BY
CASE f.name WHEN 'nation_id' THEN 0 WHEN 'total' THEN 1 WHEN 'since' THEN 2 WHEN 'segment' THEN 3 WHEN 'c_custkey' THEN 4 ELSE 5 END) AS INTEGER) AS place FROM c QUALIFY place <= 5"""


@query(_FIELDS)
def review_key_fields(spark, sf_dir):
    """The fields that stand for a table, for as many tables as there are customers."""
    fields = [("c_custkey", "int"), ("nation_id", "int"), ("total", "float"), ("since", "date"), ("segment", "category"), ("name", "string")]
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("dtype")) for n, d in fields])
    return catalog.key_fields(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.inline(listed)))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 50")
def latest_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type").orderBy(F.desc_nulls_last("ts"), F.desc("event_id")).limit(50)


@query("""SELECT c_custkey, event_id, CASE WHEN user_id IS NULL THEN 'left_only' WHEN c_custkey IS NULL THEN 'right_only' ELSE 'both' END AS _merge, c_nationkey AS key_x, value AS key_y
FROM customer FULL JOIN events ON c_custkey = user_id""")
def join_merge_indicator(spark, sf_dir):
    """A full merge that says where each row comes from, with suffixes where names clash."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("key"))
    both = c.withColumnRenamed("key", "key_x").join(e.withColumnRenamed("key", "key_y"), F.col("c_custkey") == F.col("user_id"), "full")
    side = F.when(F.col("user_id").isNull(), "left_only").when(F.col("c_custkey").isNull(), "right_only").otherwise("both")
    return both.select("c_custkey", "event_id", side.alias("_merge"), "key_x", "key_y")


@query("""WITH s AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN coalesce(CAST(last AS DATE), DATE '1970-01-01') ELSE DATE '1970-01-01' END AS seen FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def join_backfill(spark, sf_dir):
    """Rows brought up to date from another table: those that ask for it and have a match, the others as they were."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit("1970-01-01").cast("date").alias("seen"))
    new = F.when(F.col("c_acctbal") < 0, F.coalesce(F.to_date("last"), "seen")).otherwise(F.col("seen"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", new.alias("seen"))


@query("""WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders), d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT day, coalesce(n, 0) AS n FROM d LEFT JOIN n USING (day)""")
def frame_date_range(spark, sf_dir):
    """Every day of the span, those without orders too."""
    n = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    days = n.agg(F.explode(F.expr("sequence(min(day), max(day), interval 1 day)")).alias("day"))
    return days.join(n, "day", "left").fillna(0, ["n"])


@query("""SELECT l_orderkey, l_linenumber, 'l_discount' AS variable, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def frame_melt(spark, sf_dir):
    ids = ["l_orderkey", "l_linenumber"]
    return table(spark, sf_dir, "lineitem").select(*ids, "l_discount", "l_tax").unpivot(ids, ["l_discount", "l_tax"], "variable", "value")


@query("""SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, 'none' FROM supplier""")
def frame_concat_missing(spark, sf_dir):
    """Tables of different columns one after the other; what one lacks is filled."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True).fillna("none", ["segment"])


@query("""SELECT user_id, event_id, CAST(date_diff('second', lag(ts) OVER w, ts) AS BIGINT) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def frame_timedelta(spark, sf_dir):
    """Whole seconds since the event before of the same user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("SECOND", F.date_trunc("second", F.lag("ts").over(w)), F.date_trunc("second", F.col("ts")))
    return table(spark, sf_dir, "events").select("user_id", "event_id", gap.alias("seconds"))


@query("""SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, count(o_orderkey) FILTER (o_orderstatus = 'O') AS open_orders,
max(CAST(o_orderdate AS DATE)) AS last_day FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def usage_totals(spark, sf_dir):
    """Totals of each organisation: members, documents, open ones and the last day; one grouped pass over each fact table."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.max("o_orderdate").alias("last"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    c = c.groupBy("c_nationkey").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("open").alias("open"), F.max("last").alias("last"))
    n = table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    r = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_name")
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return r.agg(F.count("n_nationkey").alias("nations"), zero("m").alias("customers"), zero("n").alias("orders"), zero("open").alias("open_orders"), F.to_date(F.max("last")).alias("last_day"))
