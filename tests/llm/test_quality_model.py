"""The model of the quality classifier against brute force: whole code points, held-out folds, many shards."""

import math
from collections import Counter

import pytest
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from lodemap.llm import quality, quality_rules
from tests.llm.test_quality_rules import BruteModel

TEXTS = [" ".join(f"w{(i * k) % 13}" for k in range(3 + i % 40)) for i in range(60)] + ["The CAT sat", "the cat sat", "кот сидел", "猫坐着", "a b 🙂é\n", "the cat sat"]


class Most(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):
        return max(a, b)


def brute(texts):
    """Perplexity of each text under the model of the other fold; a fold without texts takes its own."""
    folds = [[t for t in texts if quality_rules.fold_of(t) == f] for f in (0, 1)]
    models = [BruteModel(f) for f in folds]
    pick = lambda t: models[1 - quality_rules.fold_of(t) if folds[1 - quality_rules.fold_of(t)] else quality_rules.fold_of(t)]
    return {t: math.exp(pick(t).bits(t)) for t in texts}


@pytest.mark.parametrize("held", [6_000_000, 300])
def test_perplexity_equals_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(quality_rules, "HELD", held)
    docs = spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate([*TEXTS, None, ""])], "doc_id long, text string, lang string, _mark int")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    wanted = brute(TEXTS)
    rows = quality.classify(docs.repartition(3), labels).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r["doc_id"] < len(TEXTS):
            assert r["perplexity"] == pytest.approx(wanted[TEXTS[r["doc_id"]]], rel=1e-4) and r["low"] <= r["high"]
        else:
            assert r["perplexity"] is None and not r["keep"]
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_one_fold_judges_both(spark):
    docs = spark.createDataFrame([(0, "the cat sat", "en"), (1, "other words", "en")], "doc_id long, text string, lang string")
    model = quality.train(docs.where("doc_id = 0"))
    assert model.perplexity("the cat sat") == pytest.approx(brute(["the cat sat"])["the cat sat"], rel=1e-4)
    assert model.perplexity("the cat") < model.perplexity("THE CAT") and model.perplexity("the cat") < 1_000


def test_long_texts_are_counted_piece_by_piece(spark, monkeypatch):
    for name, n in (("COUNTED_AT_ONCE", 50), ("COUNTED", 20), ("TOLD", 7)):
        monkeypatch.setattr(quality_rules, name, n)
    most, real = spark.sparkContext.accumulator(0, Most()), quality_rules.hashed

    def hashed(x, order, seeds):
        most.add(len(x))
        return real(x, order, seeds)

    monkeypatch.setattr(quality_rules, "hashed", hashed)
    texts = [(lang, t * k) for k in (1, 30) for lang in ("en", "de") for t in TEXTS]
    docs = spark.createDataFrame(texts, "lang string, text string")
    wanted = Counter()
    for lang, t in texts:
        x = "\x02" * 4 + t + "\x03"
        wanted.update((f"{quality_rules.fold_of(t)}{lang}", x[i : i + 5]) for i in range(len(x) - 4))
    assert {(r["model"], r["gram"]): r["n"] for r in quality_rules.count_grams(docs).collect()} == wanted
    assert 0 < most.value <= 1 + max(len(t) for _, t in texts)  # n-grams at once: those of one text, not of a slice


def test_tasks_get_whole_rows_once(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    out = quality.scored(docs, quality.train(docs))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    step = plan[plan.index("MapInArrow") :].split("\n")
    assert out.columns == ["doc", "perplexity"] and "_text" not in "".join(step)
