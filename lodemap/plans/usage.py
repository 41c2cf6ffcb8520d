"""Queries of usage rollups, dashboards, documents and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboards, documents, quotas, rules, search, usage
from ..operators.dashboards import Measure
from ..operators.review import apply_header, preview
from ..sources import workbooks
from ..streaming.jobs import events_as_jobs
from ..streaming.rollup import daily_rollup_once
from ..streaming.signin import spaced_once
from .registry import SQL, query, table

_DAILY = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


@query(_DAILY)
def usage_daily_rollup(spark, sf_dir):
    return usage.daily(table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("total", F.round("total", 2))


@query(_DAILY)
def usage_merged_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = [usage.daily(e.where(f"event_id % 2 = {k}"), ["event_type"], "value") for k in (0, 1)]
    return usage.merged(*parts, ["event_type"]).withColumn("total", F.round("total", 2))


@query(_DAILY)
def stream_daily_rollup(spark, sf_dir):
    """The same rollup as a stream over the table's files, once through."""
    return daily_rollup_once(spark, sf_dir)


@query("SELECT strftime(ts, '%Y-%m') AS month, user_id, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY 1, 2")
def usage_monthly(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-01' and ts < timestamp_ntz'2024-02-01'")
    return e.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def usage_by_property(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY 1")
def activity_by_day(spark, sf_dir):
    return table(spark, sf_dir, "events").where(~F.col("event_type").isin("error", "signup")).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
k AS (SELECT user_id, event_id, r, ts AS last, true AS kept FROM e WHERE r = 1 UNION ALL
      SELECT e.user_id, e.event_id, e.r, CASE WHEN e.ts - k.last >= INTERVAL 10 MINUTE THEN e.ts ELSE k.last END, e.ts - k.last >= INTERVAL 10 MINUTE
      FROM k JOIN e ON e.user_id = k.user_id AND e.r = k.r + 1)
SELECT user_id, event_id FROM k WHERE kept""")
def signin_dedup(spark, sf_dir):
    return usage.spaced(table(spark, sf_dir, "events"))


@query(SQL["signin_dedup"])
def stream_signin_dedup(spark, sf_dir):
    """The same as a stream over the table's files, once through."""
    return spaced_once(spark, sf_dir)


@query("""SELECT CAST(event_id AS VARCHAR) AS job_id, event_type AS kind, CASE event_type WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status,
CAST(CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS INTEGER) AS attempts, CASE event_type WHEN 'error' THEN 'no error' END AS message FROM events""")
def stream_jobs(spark, sf_dir):
    """Events as jobs, claimed by the batches of a stream, worked on and tried again."""
    return events_as_jobs(spark, sf_dir)


@query("""WITH r AS (SELECT o_orderkey, 'prices' AS module, 'o_totalprice is outside 1000 to 400000' AS message FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 400000
UNION ALL SELECT o_orderkey, 'states', 'finished orders need a clerk' FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
SELECT o_orderkey AS order_id, module, message FROM r""")
def rule_checks(spark, sf_dir):
    """What the checks of two modules say of the orders, a row for each message."""
    modules = rules.Modules()
    modules.register(rules.Module("prices", checks=(rules.within("o_totalprice", 1_000, 400_000), rules.needed("o_orderkey"))))
    urgent = lambda r: ["finished orders need a clerk"] if (r["o_orderstatus"], r["o_orderpriority"]) == ("F", "1-URGENT") else []
    modules.register(rules.Module("states", checks=(urgent,)))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return modules.checked(orders).select(F.col("o_orderkey").alias("order_id"), "module", "message")


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0) AS total
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ROLLUP (r_name, n_name)""")
def ops_dashboard(spark, sf_dir):
    """One grouped pass over each fact table, joined on the owner; totals by rollup."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    c = c.groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    both = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").rollup("r_name", "n_name")
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return both.agg(zero("customers").alias("customers"), zero("orders").alias("orders"), F.round(zero("v"), 2).alias("total"))


@query("""WITH u AS (SELECT user_id, count(*) AS used FROM events GROUP BY 1)
SELECT user_id, used, CAST(greatest(0, floor(25 * (80 + user_id % 3 * 20) / 100)) AS BIGINT) AS hard_cap, used > greatest(0, floor(25 * (80 + user_id % 3 * 20) / 100)) AS over FROM u""")
def quota_report(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("used"))
    limit = usage.cap(F.lit(25), 80 + F.col("user_id") % 3 * 20)
    return u.select("user_id", "used", limit.alias("hard_cap"), (F.col("used") > limit).alias("over"))


@query("""WITH u AS (SELECT c_nationkey AS org, o_custkey AS "user", o_totalprice AS v, o_orderstatus AS st, o_orderdate AS d FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT org, "user", 'sessions' AS kind, count(*)::DOUBLE AS used FROM u GROUP BY ALL UNION ALL SELECT org, "user", 'storage', sum(v) FROM u GROUP BY ALL
UNION ALL SELECT org, "user", 'upload', sum(v) FROM u WHERE year(d) = 1996 GROUP BY ALL UNION ALL SELECT org, "user", 'jobs', count(*) FROM u WHERE st = 'O' GROUP BY ALL
UNION ALL SELECT org, "user", 'tokens', sum(v) FROM u WHERE d >= TIMESTAMP '1998-01-01' GROUP BY ALL UNION ALL SELECT org, "user", 'file_size', max(v) FROM u GROUP BY ALL),
l(kind, ul, ol) AS (VALUES ('sessions', 12, 700), ('storage', 2000000, 60000000), ('upload', 500000, 20000000), ('jobs', 6, 300), ('tokens', 200000, 6000000), ('file_size', 60000, 50000)),
r AS (SELECT org, "user", kind, 'user' AS scope, used, ul AS lim FROM k JOIN l USING (kind) UNION ALL
SELECT org, "user", kind, 'organization', sum(used) OVER (PARTITION BY org, kind), ol FROM k JOIN l USING (kind))
SELECT org, "user", kind, scope, round(used, 2) AS used, greatest(0, floor(lim * 90.0 / 100))::DOUBLE AS cap,
CASE WHEN kind IN ('sessions', 'jobs') THEN used >= greatest(0, floor(lim * 90.0 / 100)) WHEN kind = 'file_size' THEN 50000 > greatest(0, floor(lim * 90.0 / 100))
ELSE used + CASE WHEN kind = 'storage' OR kind = 'upload' THEN 50000 ELSE 0 END > greatest(0, floor(lim * 90.0 / 100)) END AS refused FROM r""")
def quota_checks(spark, sf_dir):
    """Six kinds of quota of customers and their nations, and whether a file of 50 000 still fits at 90 percent."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("org"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("user"))
    v = F.col("o_totalprice")
    used = [
        quotas.used_by(o, "sessions"), quotas.used_by(o, "storage", v), quotas.used_by(o.where("year(o_orderdate) = 1996"), "upload", v), quotas.used_by(o.where("o_orderstatus = 'O'"), "jobs"),
        quotas.used_by(o.where("o_orderdate >= timestamp_ntz'1998-01-01'"), "tokens", v), o.groupBy("org", "user").agg(F.max(v).alias("used")).withColumn("kind", F.lit("file_size")),
    ]
    most = {"sessions": (12, 700), "storage": (2_000_000, 60_000_000), "upload": (500_000, 20_000_000), "jobs": (6, 300), "tokens": (200_000, 6_000_000), "file_size": (60_000, 50_000)}
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n[0]).cast("double").alias("limit")) for k, n in most.items()]))
    whole = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n[1]).cast("double").alias("limit")) for k, n in most.items()]))
    limits = c.select("org", "user", rows).unionByName(c.select("org").distinct().select("org", F.lit(None).cast("long").alias("user"), whole))
    return quotas.checks(used, limits, {"storage": 50_000, "upload": 50_000, "file_size": 50_000}, 90)


_FACTS = """WITH m AS (SELECT c_nationkey AS org, c_custkey AS "user", c_name AS name, c_acctbal > 0 AS active FROM customer),
o AS (SELECT m.*, o_totalprice AS v, o_orderstatus AS st, o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01' AS now FROM orders JOIN m ON o_custkey = "user"),
e AS (SELECT m.*, value AS v, event_type AS t FROM events JOIN m ON user_id = "user")"""


def _measures(spark, sf_dir):
    """Customers of nations as members, their orders as files and their events as work on them."""
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("org"), F.col("c_custkey").alias("user"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("active"))
    who = members.select("org", "user")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user").join(who, "user")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), "event_type", "value").join(who, "user")
    return members, [
        Measure("files", orders),
        Measure("storage", orders, dashboards.SUM, "o_totalprice", members_only=True),
        Measure("upload_month", orders, dashboards.SUM, "o_totalprice", "o_orderdate"),
        Measure("failed_month", orders.where("o_orderstatus = 'F'"), moment="o_orderdate"),
        Measure("turns", events.where("event_type = 'view'")),
        Measure("mean_response", events.where("event_type = 'click'"), dashboards.MEAN, "value"),
    ]


def _rounded(df):
    return df.withColumns({c: F.round(c, n) for c, n in {"storage": 2, "upload_month": 2, "mean_response": 9}.items()})


@query(_FACTS + """, po AS (SELECT "user", count(*) AS files, sum(v) AS storage, sum(v) FILTER (now) AS upload, count(*) FILTER (now AND st = 'F') AS failed FROM o GROUP BY 1),
pe AS (SELECT "user", count(*) FILTER (t = 'view') AS turns, avg(v) FILTER (t = 'click') AS mean FROM e GROUP BY 1)
SELECT org, "user", name, coalesce(files, 0) AS files, round(coalesce(storage, 0), 2) AS storage, round(coalesce(upload, 0), 2) AS upload_month, coalesce(failed, 0) AS failed_month,
coalesce(turns, 0) AS turns, round(mean, 9) AS mean_response FROM m LEFT JOIN po USING ("user") LEFT JOIN pe USING ("user") WHERE active""")
def org_dashboard_users(spark, sf_dir):
    return _rounded(dashboards.users(*_measures(spark, sf_dir), "1996-03"))


@query(_FACTS + """, g AS (SELECT org, false AS every FROM m GROUP BY 1 UNION ALL SELECT NULL, true)
SELECT g.org, every, (SELECT count(*) FROM m WHERE active AND (every OR m.org = g.org)) AS users, (SELECT count(*) FROM o WHERE every OR o.org = g.org) AS files,
(SELECT round(coalesce(sum(v), 0), 2) FROM o WHERE active AND (every OR o.org = g.org)) AS storage, (SELECT round(coalesce(sum(v), 0), 2) FROM o WHERE now AND (every OR o.org = g.org)) AS upload_month,
(SELECT count(*) FROM o WHERE now AND st = 'F' AND (every OR o.org = g.org)) AS failed_month, (SELECT count(*) FROM e WHERE t = 'view' AND (every OR e.org = g.org)) AS turns,
(SELECT round(avg(v), 9) FROM e WHERE t = 'click' AND (every OR e.org = g.org)) AS mean_response FROM g""")
def org_dashboard_totals(spark, sf_dir):
    """Totals of each organisation and of all of them."""
    return _rounded(dashboards.totals(*_measures(spark, sf_dir), "1996-03"))


@query("""SELECT c_nationkey AS org, user_id AS "user", event_id, event_type, ts, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank
FROM events JOIN customer ON user_id = c_custkey QUALIFY rank <= 50""")
def org_recent_events(spark, sf_dir):
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("org"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), "event_id", "event_type", "ts").join(who, "user")
    return dashboards.recent(events, "event_id", "ts")


@query("SELECT n_name, count(*) FILTER (c_acctbal > 0) AS active, count(c_custkey) AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def org_member_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("active"), F.count("*").alias("members"))
    n = table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.select("n_name", *[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in ("active", "members")])


@query("SELECT sha256(text) AS sha256, min(doc_id) AS kept, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"))


_W = "regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)')"


# The common words, written out once more so that the query is held against something else than its own list.
_COMMON = """a about account all amount an and are as at be by date document for from has in invoice is it name no not of on or page payment section
shall tax term that the this to total value with"""
_TIDY = r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '\s+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_RATIOS = f"""SELECT doc_id, t, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN {tuple(_COMMON.split())!r})) / len(w) ELSE 0 END AS dictionary,
CASE WHEN length(t) > 0 THEN (length(t) - length(regexp_replace(t, '[\\p{{L}}\\p{{N}}]', '', 'g'))) / length(t) ELSE 0 END AS alphanumeric,
CASE WHEN length(t) > 0 THEN (length(t) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g'))) / length(t) ELSE 0 END AS non_ascii
FROM (SELECT doc_id, {_TIDY} AS t, regexp_extract_all(lower(t), '[a-z]{{2,}}') AS w FROM documents)"""


@query(f"SELECT doc_id, round(dictionary, 6) AS dictionary, round(alphanumeric, 6) AS alphanumeric, round(non_ascii, 6) AS non_ascii FROM ({_RATIOS})")
def doc_text_ratios(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[F.round(c, 6).alias(n) for n, c in documents.ratios(F.col("text")).items()])


@query(f"""SELECT doc_id, round(0.52 * 0.98 + 0.2 * dictionary + 0.16 * alphanumeric + 0.12 * (1 - CASE WHEN t = '' THEN 1 ELSE
(length(t) - length(regexp_replace(t, '\\[illegible\\]', '', 'gi'))) / length(t) END), 4) AS score,
length(trim(regexp_replace(t, '\\s+', ' ', 'g'))) >= 80 AND dictionary >= 0.18 AND non_ascii <= 0.35 AND alphanumeric >= 0.25 AS readable FROM ({_RATIOS})""")
def doc_quality_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(documents.quality(F.col("text"), F.lit(0.98)), 4).alias("score"), documents.readable(F.col("text")).alias("readable"))


@query()
def doc_chunks(spark, sf_dir):
    return documents.chunks(table(spark, sf_dir, "documents"))


TERMS = ("the", "tion", "avec", "und")
_BM25 = f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), r AS (SELECT doc_id, len(w) AS n, w FROM w), f AS (SELECT count(*) AS docs, avg(n) AS mean FROM r),
t AS (SELECT unnest({list(TERMS)!r}) AS term), c AS (SELECT doc_id, n, term, len(list_filter(w, lambda x: x = term)) AS tf FROM r, t),
d AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM c GROUP BY 1),
s AS (SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 5) AS score FROM c JOIN d USING (term), f WHERE tf > 0 GROUP BY 1),
lex AS (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20)"""
_VEC = """vec AS (SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (
  SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) QUALIFY rank <= 20)"""


def _lexical(spark, sf_dir):
    return search.best(search.bm25(table(spark, sf_dir, "documents"), list(TERMS)), 20, "doc_id")


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id = 0").first()["embedding"]  # the query's vector
    return search.best(search.nearest(e, asked), 20, "vec_id")


@query(_BM25 + " SELECT doc_id, score, rank FROM lex")
def search_bm25(spark, sf_dir):
    return _lexical(spark, sf_dir)


@query("WITH " + _VEC + " SELECT vec_id, score, rank FROM vec")
def search_vector(spark, sf_dir):
    return _vectors(spark, sf_dir)


@query(_BM25 + ", " + _VEC + """, a AS (SELECT doc_id AS id, rank FROM lex UNION ALL SELECT vec_id, rank FROM vec)
SELECT id, round(sum(1 / (60 + rank)), 8) AS score FROM a GROUP BY 1 ORDER BY score DESC, id LIMIT 10""")
def search_hybrid_rrf(spark, sf_dir):
    lists = [_lexical(spark, sf_dir).withColumnRenamed("doc_id", "id"), _vectors(spark, sf_dir).withColumnRenamed("vec_id", "id")]
    return search.fused(lists, 10)


@query("SELECT o_orderkey AS order_id, round(o_totalprice, 2) * 100000 AS amount, CAST(o_orderdate AS DATE) AS day FROM orders")
def review_scale_recast(spark, sf_dir):
    """Positional raw rows under a title and a header, as approved: names, types, lakh to units."""
    o = table(spark, sf_dir, "orders")
    body = o.select((F.col("o_orderkey") + 10).alias("_row_id"), F.col("o_orderkey").cast("string").alias("c0"), F.format_number("o_totalprice", 2).alias("c1"), F.date_format("o_orderdate", "d/M/yyyy").alias("c2"))
    head = spark.createDataFrame([(0, "Report", None, None), (1, "Order", "Amount", "Day"), (2, None, None, None)], "_row_id long, c0 string, c1 string, c2 string")
    columns = [("order_id", "int", None), ("amount", "float", 100000.0), ("day", "date", None)]
    return apply_header(head.unionByName(body), 1, columns).drop("_row_id")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation ORDER BY n_nationkey LIMIT 10")
def preview_header(spark, sf_dir):
    raw = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("_row_id"), F.col("n_nationkey").cast("string").alias("c0"), F.col("n_name").alias("c1"))
    head = spark.createDataFrame([(0, "key", "name")], "_row_id long, c0 string, c1 string")
    return preview(apply_header(head.unionByName(raw), 0, [("key", "int", None), ("name", "string", None)]), 10)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS c0, o_orderpriority AS c1, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS c2 FROM orders")
def workbook_rows(spark, sf_dir):
    """All orders written to workbooks and read back; the header of each is left out."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("o_orderdate"))
    rows = workbooks.sheet_rows(workbooks.as_workbooks(o, "orders", 5_000)).where("row_no > 0")
    return rows.select(*[F.get("cells", F.lit(k)).alias(f"c{k}") for k in range(3)])
