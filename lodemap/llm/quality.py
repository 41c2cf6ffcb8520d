"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of the trusted text.

The model is one of n-grams of whole code points (order ``ORDER`` of ``quality_rules``,
whose counts and joins it shares), trained on the text that labels trust.  Tasks sum up
n-grams, which meet by model and n-gram; lower orders count distinct left neighbours;
totals, discounts and back-off weights are joined to the n-grams by context, and the
lower probability by suffix.  All of these tables grow with the text; no character is
folded into a class and no n-gram is dropped.  The probabilities are joined to the
n-grams of each whole text where it lies: whole, or, beyond ``HELD`` entries, in shards
by context that are joined one after the other.  With one shard no text is shuffled.

Texts are dealt to two folds by their checksum, each with its own model, and take the
other's, so no text is judged by a model that saw it.  Where only one fold has trusted
text, its model judges both.

A document is kept if its perplexity lies between quantiles of the trusted text of
its language and length class, widened by a margin.  Where a class has too few
trusted documents those of its language decide, or else those of all languages.

Null and empty texts have no perplexity and are rejected.  Without any trusted
text nothing can be judged and every document with a text is kept.  Repeated rows
are judged alike.  Null languages are a language of their own.  Labels that repeat
a document count once; a document of which any label says 1 is trusted.  All other
columns are passed on as they are, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality_rules
from .quality_rules import ORDER, UNIFORM, Arrays, arrays, sums
from .shared import sized, slices, spread, stored, trusted

#: Code points among which the empty context tells nothing.
SYMBOLS = round(1 / UNIFORM)
#: Quantiles of trusted perplexity, how far they are widened, and the least number of documents they come from.
LOW, HIGH, MARGIN, LEAST = 0.002, 0.998, 1.0, 40


@dataclass
class Model:
    """The written table (kind, model, gram, value) of ``quality_rules.train``, for two folds."""

    table: DataFrame

    @cached_property
    def shards(self) -> int:
        return max(1, -(-self.table.count() // quality_rules.HELD))

    def shard(self, k: int) -> Arrays:
        return arrays(self.table, k, self.shards)

    @cached_property
    def log_p(self) -> np.ndarray:
        """Natural logarithm of the probability of each of SYMBOLS code points after each whole context; for small models."""
        lm, out = arrays(self.table, 0, 1), []
        for r in self.table.where((F.col("kind") == "b") & (F.length("gram") == ORDER - 1)).collect():
            grams = np.tile(np.array([*map(ord, r["gram"]), 0], np.uint64), (SYMBOLS, 1))
            grams[:, -1] = np.arange(SYMBOLS)
            seeds = np.array([quality_rules.seed(r["model"], k) for k in range(ORDER + 1)], np.uint64)
            out.append(lm.scores(grams, np.broadcast_to(seeds, (SYMBOLS, ORDER + 1))))
        return np.concatenate(out)

    def perplexity(self, text: str | None) -> float | None:
        """Of one text, on the driver."""
        return math.exp(-float(sums([("", text)], arrays(self.table, 0, 1))[0]) / (len(text) + 1)) if text else None


def train(docs: DataFrame, text_col: str = "text") -> Model | None:
    """Interpolated modified Kneser-Ney over all rows of ``docs``; None if there is no text."""
    texts = docs.select(F.lit("").alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    table = quality_rules.train(texts)
    folds = [r["model"] for r in table.select("model").distinct().collect()]  # two at most
    if len(folds) == 1:
        table = stored(table.unionByName(table.withColumn("model", F.lit(str(1 - int(folds[0]))))), "model")
    return Model(table) if folds else None


def logs(rows: DataFrame, lm: Arrays, text_col: str) -> DataFrame:
    """Structs ``doc`` and ``_logs``: the sum of the logarithms of a text's characters and its end that fall into the shard.

    The text is read inside the struct, so that tasks don't hold it twice.
    """
    shared = rows.sparkSession.sparkContext.broadcast(lm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            found = sums([("", t or "") for t in batch.column(0).field(text_col).to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc", "_logs"])

    return rows.select("doc").mapInArrow(run, rows.select("doc", F.lit(None).cast("double").alias("_logs")).schema)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(doc struct, perplexity double): whole rows, whatever their columns are called; null without text."""
    text = F.col("doc")[text_col]
    rows = docs.select(F.struct("*").alias("doc"))
    if model.shards == 1:
        out = logs(rows, model.shard(0), text_col)
    else:
        marked, parts = rows.select("doc", F.md5(text).alias("_mark")), None
        for k in range(model.shards):
            one = logs(rows.where(text != "").select(F.struct(F.md5(text).alias("_mark"), text.alias("_text")).alias("doc")), model.shard(k), "_text")
            one = stored(one.groupBy("doc._mark").agg(F.max("_logs").alias("_logs"), F.count("*").alias("n")), "logs")
            parts = one if parts is None else parts.unionByName(one)
        total = stored(parts.groupBy("_mark").agg(F.sum("_logs").alias("_logs"), F.max("n").alias("n")), "logs")
        out = spread(marked, total.drop("n"), ["_mark"], counts=total.select("_mark", "n"), how="left")
    return out.select("doc", F.when(text != "", F.exp(-F.col("_logs") / (F.char_length(text) + 1))).alias("perplexity"))


def length_class(text: Column) -> Column:
    return F.floor(F.log2(F.greatest(F.lit(1), F.char_length(text)))).cast("int")


def thresholds(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi): widened quantiles of (keys, ppl) in groups with enough documents."""
    q = F.percentile_approx("ppl", [LOW, 0.5, HIGH], 10_000)
    return (
        scores.groupBy(*keys)
        .agg(q.alias("q"), F.count("*").alias("n"))
        .where(F.col("n") >= LEAST)
        .select(
            *keys,
            (F.col("q")[0] - MARGIN * (F.col("q")[1] - F.col("q")[0])).alias("lo"),
            (F.col("q")[2] + MARGIN * (F.col("q")[2] - F.col("q")[1])).alias("hi"),
        )
    )


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(doc struct, perplexity, low, high double, keep boolean) of every row."""
    good = trusted(docs.select(id_col, text_col, lang_col), labels, id_col)
    model = train(good, text_col)
    if model is None:
        none = F.lit(None).cast("double")
        there = F.coalesce(F.col("doc")[text_col], F.lit("")) != ""
        return docs.select(F.struct("*").alias("doc")).select("doc", none.alias("perplexity"), none.alias("low"), none.alias("high"), there.alias("keep"))
    lang, size = F.coalesce(F.col("doc")[lang_col], F.lit("")).alias("_lang"), length_class(F.col("doc")[text_col]).alias("_size")
    seen = scored(good, model, text_col).where("perplexity is not null").select(lang, size, F.col("perplexity").alias("ppl"))
    seen = stored(seen, "trusted-perplexity")
    fine = stored(thresholds(seen, ["_lang", "_size"]), "thresholds")
    by_lang = stored(thresholds(seen, ["_lang"]).withColumnsRenamed({"lo": "lo1", "hi": "hi1"}), "language-thresholds")
    whole = seen.agg(F.percentile_approx("ppl", [0.0, 1.0], 10_000).alias("q")).first()["q"] or [0.0, math.inf]
    out = (
        scored(docs, model, text_col)
        .select("doc", "perplexity", lang, size)
        .join(sized(fine, fine.count()), ["_lang", "_size"], "left")
        .join(sized(by_lang, by_lang.count()), "_lang", "left")
    )
    low = F.coalesce("lo", "lo1", F.lit(float(whole[0]) / 2))
    high = F.coalesce("hi", "hi1", F.lit(float(whole[1]) * 2))
    keep = F.coalesce(F.col("perplexity").between(low, high), F.lit(False))
    return out.select("doc", "perplexity", low.alias("low"), high.alias("high"), keep.alias("keep"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, perplexity, low, high double, keep boolean) for every row."""
    return judge(docs.select(id_col, text_col, lang_col), labels, id_col, text_col, lang_col).select(
        F.col("doc")[id_col].alias(id_col), "perplexity", "low", "high", "keep"
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return judge(docs, labels, id_col, text_col, lang_col).where("keep").select("doc.*")
