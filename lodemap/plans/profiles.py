"""Queries of profiles, cell types, join keys and anomalies."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from ..functions import cells
from ..operators import anomalies, profile, relate, validate
from ..operators.values import value_counts
from .registry import query, table, tables

STAR = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"],
}
FREQUENT = {"customer": ["c_mktsegment", "c_nationkey"], "orders": ["o_orderstatus", "o_orderpriority"], "part": ["p_brand", "p_type", "p_size"], "events": ["event_type"]}
TEXTS = {"customer": ["c_name", "c_mktsegment"], "part": ["p_brand", "p_type", "p_name"], "orders": ["o_orderpriority"], "pages": ["url"]}
NUMBERS = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount"], "orders": ["o_totalprice"], "customer": ["c_acctbal"]}
TIMES = {"orders": ["o_orderdate"], "lineitem": ["l_shipdate"], "events": ["ts"]}
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
}


def each(columns: dict[str, list[str]], one: str) -> str:
    """UNION ALL of a statement for each column; ``{t}`` and ``{c}`` are its table and name."""
    return "\nUNION ALL\n".join(one.format(t=t, c=c) for t, cs in columns.items() for c in cs)


def long_sql(columns: dict[str, list[str]]) -> str:
    return each(columns, "SELECT '{t}' AS tab, '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM {t}")


_SIGNATURE = (
    "array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(value, '[^\\x00-\\x7F]|[a-z]', 'a', 'g'), '[B-Z]', 'A', 'g'), '[0-9]', 'D', 'g'), "
    "'(D+|A+|a+| +|[^DAa ])'), lambda t: CASE WHEN length(t) > 1 THEN t[1] || CAST(length(t) AS VARCHAR) ELSE t END), '')"
)
_SIGNED = f"WITH l AS ({long_sql(TEXTS)}), s AS (SELECT tab, col, value, {_SIGNATURE} AS signature FROM l WHERE value IS NOT NULL)"
_MAIN = """, g AS (SELECT tab, col, signature, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT tab, col, signature, n, round(n / sum(n) OVER (PARTITION BY tab, col), 4) AS coverage,
             row_number() OVER (PARTITION BY tab, col ORDER BY n DESC, signature) AS r FROM g)"""


@query(each(STAR, "SELECT '{t}' AS tab, '{c}' AS col, count(*) AS total, count({c}) AS nonnull, count(DISTINCT {c}) AS distinct_values, CASE WHEN count(*) > 0 THEN round((count(*) - count({c})) / count(*), 4) ELSE 0.0 END AS null_rate FROM {t}"))
def profile_nulls_distinct(spark, sf_dir):
    return profile.nulls_and_distinct(value_counts(tables(spark, sf_dir, STAR)))


@query(f"""WITH l AS ({long_sql(FREQUENT)}), g AS (SELECT tab, col, value, count(*) AS n FROM l GROUP BY ALL),
t AS (SELECT tab, col, value, n, round(n / sum(n) OVER (PARTITION BY tab, col), 4) AS rate FROM g)
SELECT tab, col, value, n, rate, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tab, col ORDER BY n DESC, value) AS rank FROM t WHERE value IS NOT NULL) WHERE rank <= 5""")
def profile_top_values(spark, sf_dir):
    return profile.top_values(value_counts(tables(spark, sf_dir, FREQUENT)))


@query(_SIGNED + _MAIN + " SELECT tab, col, signature, n, coverage FROM m WHERE r = 1")
def profile_signature(spark, sf_dir):
    return profile.signatures(value_counts(tables(spark, sf_dir, TEXTS)))


@query(_SIGNED + _MAIN + """, o AS (SELECT DISTINCT s.tab, s.col, s.value FROM s JOIN m USING (tab, col) WHERE m.r = 1 AND s.signature <> m.signature)
SELECT tab, col, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tab, col ORDER BY length(value), value) AS rank FROM o) WHERE rank <= 2""")
def profile_outliers(spark, sf_dir):
    return profile.signature_outliers(value_counts(tables(spark, sf_dir, TEXTS)))


@query(f"""WITH l AS ({long_sql(TEXTS)}), d AS (SELECT DISTINCT tab, col, value FROM l WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY tab, col ORDER BY length(value), value) - 1 AS rn, count(*) OVER (PARTITION BY tab, col) AS total FROM d)
SELECT tab, col, value, CAST(CASE WHEN total <= 5 THEN rn ELSE place END AS INTEGER) AS place
FROM r LEFT JOIN (SELECT unnest(range(0, 5)) AS place) p ON total > 5 AND rn = floor(place * (total - 1) / 4) WHERE total <= 5 OR place IS NOT NULL""")
def profile_samples(spark, sf_dir):
    return profile.samples(value_counts(tables(spark, sf_dir, TEXTS)))


@query(each(NUMBERS, "SELECT '{t}' AS tab, '{c}' AS col, " + ", ".join(f"CASE WHEN {e} = floor({e}) THEN {e} ELSE printf('%.5e', CAST({e} AS DOUBLE))::DOUBLE END AS {n}" for e, n in (("min({c})", "minimum"), ("max({c})", "maximum"), ("avg({c})", "mean"), ("stddev_pop({c})", "std"), *((f"quantile_cont({{c}}, {q})", f"p{round(100 * q):02d}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)))) + " FROM {t}"))
def profile_numeric(spark, sf_dir):
    out = None
    for t, df in tables(spark, sf_dir, NUMBERS).items():
        part = profile.numeric_stats(df, NUMBERS[t], t)
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH s AS (" + each(STAR, "SELECT '{t}' AS tab, '{c}' AS col, count(*) AS n, count({c}) AS there, count(DISTINCT {c}) AS d FROM {t}") + """)
SELECT tab, col, array_to_string(list_filter([
  CASE WHEN n > 0 AND there = 0 THEN 'all_null' END, CASE WHEN there > 0 AND (n - there) / n >= 0.5 THEN 'mostly_null' END, CASE WHEN d = 1 THEN 'constant' END,
  CASE WHEN there > 0 AND d / there >= 0.95 THEN 'high_cardinality' END,
  CASE WHEN regexp_matches(lower(col), '(^|_)(id|key|code|no|number)$|(id|key)$') THEN 'identifier_like' END], lambda x: x IS NOT NULL), ',') AS hints FROM s""")
def describe_hints(spark, sf_dir):
    return profile.hints(value_counts(tables(spark, sf_dir, STAR)))


@query(each(TIMES, "SELECT '{t}' AS tab, '{c}' AS col, strftime(min({c}), '%Y-%m-%dT%H:%M:%S') AS earliest, strftime(max({c}), '%Y-%m-%dT%H:%M:%S') AS latest, count({c}) AS parsed FROM {t}"))
def describe_temporal(spark, sf_dir):
    out = None
    for t, df in tables(spark, sf_dir, TIMES).items():
        part = profile.temporal_ranges(df, TIMES[t], t)
        out = part if out is None else out.unionByName(part)
    return out


@query()
def validate_columns(spark, sf_dir):
    """Confidence of declared types; the scores are checked in tests."""
    declared = {"o_orderkey": "int", "o_totalprice": "float", "o_orderdate": "datetime", "o_orderpriority": "category", "o_orderstatus": "date"}
    return validate.validate(table(spark, sf_dir, "orders"), declared)


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN -round(o_totalprice, 2) WHEN 3 THEN NULL ELSE round(o_totalprice, 2) END AS amount FROM orders")
def canon_numbers(spark, sf_dir):
    o, shown, k = table(spark, sf_dir, "orders"), F.format_number("o_totalprice", 2), F.col("o_orderkey") % 4
    cell = F.when(k == 0, F.concat(F.lit("₹ "), shown)).when(k == 1, F.concat(F.lit("("), shown, F.lit(")"))).when(k == 2, F.concat(F.lit("Rs. "), shown)).otherwise(F.lit("n/a"))
    return o.select("o_orderkey", F.round(cells.cast_cell(cell, "float"), 2).alias("amount"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN NULL ELSE o_orderpriority END AS value FROM orders")
def canon_nulls(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    cell = F.when(k == 0, F.lit(" #REF! ")).when(k == 1, F.lit("–")).otherwise(F.concat(F.lit("  "), F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select("o_orderkey", cells.clean_cell(cell).alias("value"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS open FROM orders")
def canon_bools(spark, sf_dir):
    cell = F.when(F.col("o_orderstatus") == "O", "Yes").when(F.col("o_orderstatus") == "F", " n ").otherwise("maybe")
    return table(spark, sf_dir, "orders").select("o_orderkey", cells.cast_cell(cell, "boolean").alias("open"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def canon_dates(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "d/M/yyyy").alias("day"))
    return cells.cast_columns(text, {"day": "date"}, cells.votes(text, ["day"]))


@query("""SELECT 'day_first' AS col, 'datetime' AS kind, 'd/M/yyyy' AS layout UNION ALL SELECT 'amount', 'float', NULL UNION ALL
SELECT 'early', 'string', NULL UNION ALL SELECT 'key', 'int', NULL FROM (SELECT 1) WHERE (SELECT count(*) FROM orders WHERE day(o_orderdate) > 12) > 0""")
def date_format_vote(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    early = F.when(F.dayofmonth("o_orderdate") <= 12, F.date_format("o_orderdate", "d/M/yyyy"))
    text = o.select(F.date_format("o_orderdate", "d/M/yyyy").alias("day_first"), F.format_number("o_totalprice", 2).alias("amount"), early.alias("early"), F.col("o_orderkey").cast("string").alias("key"))
    rows = [(c, v.kind, v.layout) for c, v in cells.votes(text).items()]
    return spark.createDataFrame(rows, "col string, kind string, layout string")


_N = sum(map(len, KEYS.values()))
_VALUES = f"""WITH l AS ({long_sql(KEYS)}), v AS (SELECT tab, col, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL),
w AS (SELECT *, ln(({_N} + 1.0) / (count(*) OVER (PARTITION BY value) + 1)) + 1 AS idf FROM v),
s AS (SELECT tab, col, count(*) AS size, sum(idf) AS all_idf, count(*) / sum(n) AS uniqueness, avg(length(value)) AS len FROM w GROUP BY ALL),
x AS (SELECT a.tab AS tab_a, a.col AS col_a, b.tab AS tab_b, b.col AS col_b, count(*) AS shared, sum(a.idf) AS shared_idf FROM w a JOIN w b ON a.value = b.value AND a.tab <> b.tab GROUP BY ALL),
o AS (SELECT x.*, shared / size AS containment, shared_idf / all_idf AS weighted, greatest(0, least(1, (shared_idf / shared - 1) / ln(({_N} + 1) / 2.0))) AS rarity
      FROM x JOIN s ON tab_a = tab AND col_a = col)"""


@query(_VALUES + " SELECT tab_a, col_a, tab_b, col_b, shared, round(containment, 6) AS containment, round(weighted, 6) AS weighted, round(rarity, 6) AS rarity FROM o")
def relate_value_overlap(spark, sf_dir):
    found = relate.overlaps(tables(spark, sf_dir, KEYS))
    return found.select("tab_a", "col_a", "tab_b", "col_b", "shared", *[F.round(c, 6).alias(c) for c in ("containment", "weighted", "rarity")])


_FLAT = [c for cs in KEYS.values() for c in cs]


def _likeness(a, b):
    """What two of these names must come to: none is a key term by itself, so it is the ratio of their letters alone."""
    return SequenceMatcher(None, a.replace("_", ""), b.replace("_", "")).ratio()


_NAMES = ", ".join(f"('{a}', '{b}', {_likeness(a, b)!r}::DOUBLE)" for a in _FLAT for b in _FLAT if a != b)


@query(_VALUES + f""", names(col_a, col_b, name) AS (VALUES {_NAMES}),
p AS (SELECT o.*, name, sa.uniqueness AS ua, sb.uniqueness AS ub, sa.size AS da, sb.size AS db, back.containment AS back
      FROM o JOIN names USING (col_a, col_b) JOIN s sa ON tab_a = sa.tab AND col_a = sa.col JOIN s sb ON tab_b = sb.tab AND col_b = sb.col
      LEFT JOIN o back ON back.tab_a = o.tab_b AND back.col_a = o.col_b AND back.tab_b = o.tab_a AND back.col_b = o.col_a
      WHERE sa.size >= 3 AND sb.size >= 3 AND sa.len <= 100 AND sb.len <= 100 AND o.shared >= 5 AND (o.containment >= 0.85 OR o.weighted >= 0.85)),
d AS (SELECT *, CASE WHEN ua >= 0.95 AND ub >= 0.95 AND containment >= 0.95 AND back >= 0.95 THEN 'one_to_one' WHEN ub >= 0.95 THEN 'many_to_one' ELSE 'many_to_many' END AS direction FROM p),
r AS (SELECT *, (0.40 * containment + 0.22 * weighted + 0.18 * ub + 0.12 * rarity + 0.08 * name) * CASE direction WHEN 'many_to_many' THEN 0.82 ELSE 1 END AS raw FROM d),
c AS (SELECT *, CASE WHEN least(da, db) < 12 AND name < 0.65 THEN least(raw, 0.55) ELSE raw END AS score, tab_a || '.' || col_a AS a, tab_b || '.' || col_b AS b FROM r)
SELECT left(sha1(concat_ws('|', tab_a, lower(col_a), tab_b, lower(col_b))), 12) AS candidate_id, tab_a, col_a, tab_b, col_b, direction, shared, round(containment, 4) AS containment,
       round(weighted, 4) AS weighted, round(ub, 4) AS parent_unique, round(rarity, 4) AS rarity, round(name, 4) AS name, round(score, 4) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY score DESC, a, b) AS rk FROM c WHERE score >= 0.72) WHERE rk = 1""")
def relate_score(spark, sf_dir):
    return relate.candidates(tables(spark, sf_dir, KEYS), None)


def _mad_sql(t: str, c: str, key: str, z: float) -> str:
    return f"""SELECT '{t}' AS tab, '{c}' AS col, 'mad' AS detector, {key} AS row_id, round({c}, 4) AS value, round(least(100.0, z / {z} * 50), 4) AS score FROM (
  SELECT {key}, {c}, abs({c} - mid) / (1.4826 * (SELECT median(abs({c} - (SELECT median({c}) FROM {t}))) FROM {t})) AS z
  FROM {t}, (SELECT median({c}) AS mid FROM {t})) WHERE z > {z}"""


@query(_mad_sql("events", "value", "event_id", 3.5) + " UNION ALL " + _mad_sql("customer", "c_acctbal", "c_custkey", 1.2))
def anomaly_mad(spark, sf_dir):
    a = anomalies.outliers(table(spark, sf_dir, "events"), "value", "event_id", "events")
    b = anomalies.outliers(table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", "customer", 1.2)
    return a.unionByName(b).withColumn("value", F.round(F.col("value").cast("double"), 4))


def _rare_sql(t: str, c: str, key: str) -> str:
    return f"""SELECT '{t}' AS tab, '{c}' AS col, 'rare_value' AS detector, {key} AS row_id, {c} AS value, round(100 * (1 - f / 0.01), 4) AS score
FROM (SELECT {key}, {c}, count(*) OVER (PARTITION BY {c}) / count(*) OVER () AS f FROM {t}) WHERE f < 0.01 AND {c} IS NOT NULL"""


_ORPHANS = """SELECT 'lineitem' AS tab, 'l_partkey' AS col, 'orphan_key' AS detector, l_orderkey AS row_id, CAST(l_partkey AS VARCHAR) AS value, 80.0::DOUBLE AS score
FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)"""


@query(_rare_sql("part", "p_type", "p_partkey") + " UNION ALL " + _rare_sql("customer", "c_name", "c_custkey"))
def anomaly_rare(spark, sf_dir):
    a = anomalies.rare_values(table(spark, sf_dir, "part"), "p_type", "p_partkey", "part")
    return a.unionByName(anomalies.rare_values(table(spark, sf_dir, "customer"), "c_name", "c_custkey", "customer"))


@query(_ORPHANS)
def anomaly_orphan(spark, sf_dir):
    parent = table(spark, sf_dir, "part")
    return anomalies.orphans(table(spark, sf_dir, "lineitem"), "l_partkey", parent, "p_partkey", "l_orderkey", "lineitem")


@query(f"""WITH u AS (SELECT tab, col, detector, row_id, score FROM ({_rare_sql('part', 'p_type', 'p_partkey')}) UNION ALL SELECT tab, col, detector, row_id, score FROM ({_rare_sql('customer', 'c_name', 'c_custkey')})),
f AS (SELECT *, row_number() OVER (PARTITION BY tab, col, detector ORDER BY row_id) AS r FROM u)
SELECT tab, col, detector, row_id, score FROM f WHERE r <= 100 ORDER BY score DESC, tab, col, detector, row_id LIMIT 50""")
def anomaly_top(spark, sf_dir):
    return anomalies.worst(anomalies.first_of_each(anomaly_rare(spark, sf_dir)), 50).drop("value")
