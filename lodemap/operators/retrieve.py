"""Hybrid retrieval over an index of chunks: a full-text and a vector list, fused by reciprocal ranks, with citations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import embeddings, fulltext
from .search import RRF, nearest

#: Each list holds so many times the wanted hits; the wanted hits lie between these bounds.
LISTS, LEAST, MOST = 4, 1, 10


def index_chunks(chunks: DataFrame, path: str, keys: Sequence[str] = ("doc_id", "chunk"), text_col: str = "text", scope: Sequence[str] = (), name: str = "feature-hash", dimension: int = embeddings.DIMENSION) -> fulltext.Index:
    """The full-text index of the chunks and a vector of each, under ``path``."""
    index = fulltext.build(chunks, path, keys, text_col, scope)
    stored = index.read(chunks.sparkSession, "chunks").select(*keys, *scope, F.col(text_col).alias("text"))
    embeddings.embedded(stored, name, dimension).drop("text").write.mode("overwrite").parquet(f"{path}/vectors")
    return index


def wanted(top_n: int) -> int:
    """The number of hits, brought between its bounds."""
    return max(LEAST, min(MOST, int(top_n)))


def ranked(scores: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """(keys, rank) of the k best of (keys, score): ties in the order of chunks, then of documents. Each task keeps its own k best."""
    order = [F.desc("score"), *[F.col(c) for c in reversed(keys)]]
    best = scores.withColumn("score", F.round("score", 6)).orderBy(*order).limit(k).where("score is not null")  # nulls come last; asked before, each score would be made twice
    return best.select(*keys, F.row_number().over(Window.orderBy(*order)).alias("rank"))  # k rows


def citation(name: Column, page: Column, section: Column, clause: Column) -> Column:
    """``file, page 3, section 4, clause 4.1``: parts that are there."""
    part = lambda word, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(word), c.cast("string")))
    return F.concat_ws(", ", name, part("page ", page), part("section ", section), part("clause ", clause))


def hybrid(
    spark: SparkSession,
    index: fulltext.Index,
    question: str,
    top_n: int = 8,
    within: Column | None = None,
    rerank: Callable[[str, DataFrame], DataFrame] | None = None,
    name: str = "feature-hash",
    dimension: int = embeddings.DIMENSION,
) -> DataFrame:
    """The chunks' own columns and ``score``: the best hits of both lists, at most ``top_n``, in order.

    ``within`` keeps both lists inside a scope. A question without words has no hits.
    ``rerank`` may put the hits in another order.
    """
    keys, k = list(index.keys), LISTS * wanted(top_n)
    chunks = index.read(spark, "chunks")
    if not question.strip():
        return chunks.withColumn("score", F.lit(0.0)).where(F.lit(False))
    vectors = index.read(spark, "vectors")
    if within is not None:
        vectors = vectors.where(within)
    asked = embeddings.embedded_query(question, name, dimension)
    near = nearest(vectors.withColumn("_k", F.struct(*keys)), asked, "_k").select("_k.*", "score")
    lists = ranked(fulltext.search(spark, index, question, None, within), keys, k).unionByName(ranked(near, keys, k))
    fused = lists.groupBy(*keys).agg(F.sum(1 / (RRF + F.col("rank"))).alias("score"))
    order = [F.round("score", 8).desc(), *[F.col(c) for c in reversed(keys)]]
    best = fused.orderBy(*order).limit(wanted(top_n))
    hits = chunks.join(F.broadcast(best), keys).orderBy(*order)  # at most MOST rows
    return rerank(question, hits) if rerank else hits
