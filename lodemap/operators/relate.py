"""Join keys between tables, from the values their columns share.

Pairs of columns come from grouping by value: each value's columns are a set of bits,
and equal sets are counted before pairs are made of them, so there is no self join
and no hot value, and what follows the one shuffle by value is of the schema's size.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable, name_similarity, normal_value, squeezed
from ..sources.shared import written
from .profile import signatures
from .values import long_form, value_counts

# Gates and weights of the score.
MIN_DISTINCT, MIN_SHARED, MAX_LENGTH = 3, 5, 100
MIN_CONTAINMENT, UNIQUE, FEW, FEW_CAP, NAME_FLOOR = 0.85, 0.95, 12, 0.55, 0.65
WEIGHTS = {"containment": 0.40, "weighted": 0.22, "parent_unique": 0.18, "rarity": 0.12, "name": 0.08}
MANY, LEAST_SCORE, MOST, SIGNATURE_SHARE = 0.82, 0.72, 30, 0.75
WORD_BITS = 62
KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "date": "date", "timestamp": "datetime",
    "timestamp_ntz": "datetime", "boolean": "bool",
}


def kinds_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(tab, col, kind): logical types of all plain columns."""
    rows = [(t, c, KINDS.get(k, "float" if k.startswith("decimal") else "string")) for t, df in tables.items() for c, k in df.dtypes if not k.startswith(("array", "map", "struct"))]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "tab string, col string, kind string")


def key_values(counts: DataFrame) -> DataFrame:
    """(tab, col, value, n): normalised values, without nulls and long ones."""
    return counts.select("tab", "col", normal_value(F.col("value")).alias("value"), "n").where("value is not null").groupBy("tab", "col", "value").agg(F.sum("n").alias("n"))


def stats(values: DataFrame) -> DataFrame:
    """(tab, col, rows, distinct, uniqueness, avg_length)."""
    return values.groupBy("tab", "col").agg(
        F.sum("n").alias("rows"), F.count("*").alias("distinct"), (F.count("*") / F.sum("n")).alias("uniqueness"), F.avg(F.length("value")).alias("avg_length")
    )


def idf(n_columns: int, df: Column) -> Column:
    return F.ln(F.lit(n_columns + 1.0) / (df + 1)) + 1


def columns_of(tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    return [(t, c) for t, df in tables.items() for c, k in df.dtypes if not k.startswith(("array", "map", "struct"))]


def holders(values: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """(cols array of (tab, col), n): how many values are in exactly these columns.

    A value's columns are bits of long words, so partial aggregates leave a row for
    each value and task before the one shuffle by value; ``values`` may hold a
    value of a column many times.  The sets of columns that occur are few; null
    values are in no column.
    """
    words = range(-(-len(columns) // WORD_BITS))
    bits = []
    for w in words:
        mine = [F.when(F.col("value").isNotNull() & (F.col("tab") == t) & (F.col("col") == c), F.lit(1 << i % WORD_BITS)) for i, (t, c) in enumerate(columns) if i // WORD_BITS == w]
        bits.append(F.bit_or(F.coalesce(*mine, F.lit(0)).cast("long")).alias(f"_w{w}"))
    sets = values.groupBy("value").agg(*bits).groupBy(*[f"_w{w}" for w in words]).agg(F.count("*").alias("n"))
    there = lambda i: F.col(f"_w{i // WORD_BITS}").bitwiseAND(F.lit(1 << i % WORD_BITS)) != 0
    cols = [F.when(there(i), F.struct(F.lit(t).alias("tab"), F.lit(c).alias("col"))) for i, (t, c) in enumerate(columns)]
    return sets.select(F.array_compact(F.array(*cols)).alias("cols"), "n")


def overlaps(tables: dict[str, DataFrame]) -> DataFrame:
    """(tab_a, col_a, tab_b, col_b, shared, containment, weighted, rarity): how much of column a is in column b.

    One read of each table and one shuffle by value.
    """
    columns = columns_of(tables)
    parts = [long_form(df, None, t) for t, df in tables.items()]
    plain = reduce(DataFrame.unionByName, parts).select("tab", "col", F.lower(squeezed(F.col("value"))).alias("value"))
    cells = plain.select("tab", "col", comparable(F.col("value")).alias("value"))  # two steps, so that the text is tidied once
    return _overlaps(cells, columns)


def _overlaps(values: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """A pair of a column with itself counts the whole column; rows are pairs of columns from the first sum on."""
    n = len(columns)
    weight = F.col("n") * idf(n, F.size("cols"))
    pairs = holders(values, columns).select(F.explode("cols").alias("a"), "cols", "n", weight.alias("w")).select("a", F.explode("cols").alias("b"), "n", "w")
    pairs = pairs.where("a = b or a.tab <> b.tab").groupBy("a", "b").agg(F.sum("n").alias("shared"), F.sum("w").alias("shared_idf"))
    own, itself = Window.partitionBy("a"), F.col("a") == F.col("b")
    whole = lambda c: F.max(F.when(itself, F.col(c))).over(own)
    pairs = pairs.withColumn("size", whole("shared")).withColumn("all_idf", whole("shared_idf")).where("a.tab <> b.tab")
    top = math.log((n + 1) / 2) if n > 1 else 1.0
    rare = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("shared_idf") / F.col("shared") - 1) / top))
    ends = [F.col(f"{e}.{k}").alias(f"{k}_{e}") for e in "ab" for k in ("tab", "col")]
    return pairs.select(*ends, "shared", (F.col("shared") / F.col("size")).alias("containment"), (F.col("shared_idf") / F.col("all_idf")).alias("weighted"), rare.alias("rarity"))


def candidates(tables: dict[str, DataFrame], limit: int | None = MOST) -> DataFrame:
    """Scored join keys, child to parent, the best direction of each pair of columns, at most ``limit`` (a report).

    (candidate_id, tab_a, col_a, tab_b, col_b, direction, shared, containment, weighted, parent_unique, rarity, name, score)
    """
    counts = written(value_counts(tables), "value-counts")
    values = written(key_values(counts), "key-values")
    kinds = kinds_of(tables)
    facts = (
        stats(values).join(kinds, ["tab", "col"]).join(signatures(counts).select("tab", "col", "signature", "coverage"), ["tab", "col"], "left")
        .where((F.col("distinct") >= MIN_DISTINCT) & (F.col("avg_length") <= MAX_LENGTH))
    )
    side = lambda s: F.broadcast(facts.select(*[F.col(c).alias(f"{c}_{s}") for c in facts.columns]))  # noqa: E731  a row a column
    p = _overlaps(values, columns_of(tables)).join(side("a"), ["tab_a", "col_a"]).join(side("b"), ["tab_b", "col_b"])
    numeric = F.col("kind_a").isin("int", "float") & F.col("kind_b").isin("int", "float")
    text = lambda c: F.when(F.col(c).isin("string", "category"), "text").otherwise(F.col(c))
    formats = (F.col("signature_a") == F.col("signature_b")) | (F.least("coverage_a", "coverage_b") < SIGNATURE_SHARE)
    fits = numeric | ((text("kind_a") == text("kind_b")) & F.coalesce(formats, F.lit(True)))
    p = p.where(fits & (F.col("shared") >= MIN_SHARED) & ((F.col("containment") >= MIN_CONTAINMENT) | (F.col("weighted") >= MIN_CONTAINMENT)))
    p = p.withColumn("name", name_similarity("col_a", "col_b"))
    one_a, one_b = F.col("uniqueness_a") >= UNIQUE, F.col("uniqueness_b") >= UNIQUE
    temporal = F.col("kind_a").isin("date", "datetime") & one_a & one_b & (F.col("name") < 0.85)
    p = p.where(~temporal)
    back = p.select(*[F.col(c).alias({"tab_a": "tab_b", "col_a": "col_b", "tab_b": "tab_a", "col_b": "col_a", "containment": "back"}[c]) for c in ("tab_a", "col_a", "tab_b", "col_b", "containment")])
    p = p.join(back, ["tab_a", "col_a", "tab_b", "col_b"], "left")
    both = one_a & one_b & (F.col("containment") >= UNIQUE) & (F.coalesce("back", F.lit(0.0)) >= UNIQUE)
    p = p.withColumn("direction", F.when(both, "one_to_one").when(one_b, "many_to_one").otherwise("many_to_many")).withColumn("parent_unique", F.col("uniqueness_b"))
    raw = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    raw = F.when(F.col("direction") == "many_to_many", raw * MANY).otherwise(raw)
    few = (F.least("distinct_a", "distinct_b") < FEW) & (F.col("name") < NAME_FLOOR)
    p = p.withColumn("score", F.when(few, F.least(raw, F.lit(FEW_CAP))).otherwise(raw)).where(F.col("score") >= LEAST_SCORE)
    a, b = F.concat("tab_a", F.lit("."), "col_a"), F.concat("tab_b", F.lit("."), "col_b")
    pair = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(F.desc("score"), a, b)
    ident = F.left(F.sha1(F.encode(F.concat_ws("|", "tab_a", F.lower("col_a"), "tab_b", F.lower("col_b")), "UTF-8")), F.lit(12))
    best = p.withColumn("r", F.row_number().over(pair)).where("r = 1").select(
        ident.alias("candidate_id"), "tab_a", "col_a", "tab_b", "col_b", "direction", "shared",
        *[F.round(c, 4).alias(c) for c in ("containment", "weighted", "parent_unique", "rarity", "name", "score")],
    )
    if limit is None:
        return best
    return best.orderBy(F.desc("score"), F.desc("parent_unique"), F.desc("containment"), F.desc("name"), "candidate_id").limit(limit)


def shared_samples(tables: dict[str, DataFrame], pairs: DataFrame, k: int = 10) -> DataFrame:
    """``pairs`` with ``samples``: the k smallest values that both columns of each candidate hold.

    Values of the columns in question meet by value; of each pair a task keeps its own k smallest ones.
    """
    values = key_values(value_counts(tables)).select("tab", "col", "value")
    ends = pairs.select("tab_a", "col_a", "tab_b", "col_b")
    a = values.join(F.broadcast(ends), (F.col("tab") == F.col("tab_a")) & (F.col("col") == F.col("col_a"))).select(*ends.columns, "value")
    b = values.select(F.col("tab").alias("tab_b"), F.col("col").alias("col_b"), "value")
    place = F.row_number().over(Window.partitionBy(*ends.columns).orderBy("value"))
    firsts = a.join(b, ["tab_b", "col_b", "value"], "left_semi").withColumn("_r", place).where(F.col("_r") <= k)
    listed = firsts.groupBy(*ends.columns).agg(F.sort_array(F.collect_list("value")).alias("samples"))
    return pairs.join(F.broadcast(listed), ends.columns, "left")  # a row a candidate


def join_by_link(tables: dict[str, DataFrame], link: dict, how: str = "left") -> DataFrame:
    """Joins the two tables of a link on its columns; columns of the parent that clash get the table's name before them.

    Keys are compared as the typed values they are if the types agree, else as text.
    """
    child, parent = tables[link["tab_a"]], tables[link["tab_b"]]
    renamed = parent.select(*[F.col(f"`{c}`").alias(f"{link['tab_b']}_{c}" if c in child.columns else c) for c in parent.columns])
    key = f"{link['tab_b']}_{link['col_b']}" if link["col_b"] in child.columns else link["col_b"]
    left, right = child[link["col_a"]], renamed[key]
    if dict(child.dtypes)[link["col_a"]] != dict(parent.dtypes)[link["col_b"]]:
        left, right = left.cast("string"), right.cast("string")
    return child.join(renamed, left == right, how)
