"""Search over texts and vectors: BM25, cosine, and both fused by reciprocal ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words

K1, B, RRF = 1.2, 0.75, 60


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score): texts that hold any of the terms.

    Texts are read once: lengths and counts of the few terms are made in one
    projection, and only averages and document frequencies are aggregated.
    """

    def count_of(term: str) -> Column:
        return F.size(F.filter("_w", lambda w: w == term))

    counts = [count_of(t).alias(f"_t{i}") for i, t in enumerate(terms)]
    rows = docs.select(F.col(id_col), words(F.coalesce(F.col(text_col), F.lit(""))).alias("_w")).select(id_col, F.size("_w").alias("_n"), *counts)
    facts = rows.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *[F.count_if(F.col(f"_t{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    held = rows.where(" or ".join(f"_t{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(facts))  # a one-row side
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_t{i}"), F.col(f"_df{i}")
        idf = F.ln(1 + (F.col("_docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_n") / F.col("_avg")))
    return held.select(id_col, score.alias("score"))


def nearest(vectors: DataFrame, query: list[float], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, score): cosine of every vector with the query's, exact; null if one of them has no length."""
    asked, length = [float(x) for x in query], 0.0
    for x in asked:
        length += x * x
    v, double = F.col(vector_col), lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(v, F.array(*map(F.lit, asked)), lambda p, q: double(p) * q), F.lit(0.0), lambda s, x: s + x)
    own = F.aggregate(v, F.lit(0.0), lambda s, x: s + double(x) * double(x))
    return vectors.select(id_col, F.try_divide(dot, F.sqrt(own) * F.lit(math.sqrt(length))).alias("score"))


def best(scores: DataFrame, k: int, id_col: str) -> DataFrame:
    """(id_col, score, rank) of the k best, ties by id."""
    top = scores.select(id_col, F.round("score", 5).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def fused(rankings: list[DataFrame], k: int, id_col: str = "id") -> DataFrame:
    """(id_col, score): sum of 1 / (60 + rank) over rankings of (id_col, rank)."""
    all_ranks = rankings[0].select(id_col, "rank")
    for r in rankings[1:]:
        all_ranks = all_ranks.unionByName(r.select(id_col, "rank"))
    out = all_ranks.groupBy(id_col).agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 8).alias("score"))
    return out.orderBy(F.desc("score"), id_col).limit(k)
