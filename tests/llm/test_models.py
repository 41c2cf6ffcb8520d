"""Jaccard join, quality, toxicity and licences against brute force, SQL and held-out rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemap.llm import decontaminate, jaccard, licenses, quality, queries, shared, toxicity
from lodemap.llm.shared import table
from tests.compare import assert_same
from tests.conftest import LARGER, SMALL, TINY


def shingle_set(text, n):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute_components(docs, n=3, num=90, den=100):
    sets = [shingle_set(t, n) for _, t in docs]
    label = list(range(len(docs)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                label[top(i)] = top(j)
    low = {}
    for i, (doc_id, _) in enumerate(docs):
        low[top(i)] = min(low.get(top(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), low[top(i)]) for i, (doc_id, _) in enumerate(docs))


def test_jaccard_equals_brute_force_on_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, TINY, "documents").collect()]
    assert sorted(tuple(r) for r in queries.op4_jaccard_join(spark, TINY).collect()) == brute_components(docs)


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_equals_brute_force_on_edited_texts(spark, n, num):
    rnd = random.Random(n * num)
    docs = []
    for _ in range(12):
        base = [rnd.choice("abcdefghij") * rnd.randint(1, 4) for _ in range(rnd.choice([2, 5, 40, 150]))]
        for _ in range(rnd.randint(1, 9)):
            words = list(base)
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(["zz", "yy", "xx"])
            docs.append((len(docs) + 1, " ".join(words).title() if rnd.random() < 0.3 else " ".join(words)))
    docs += [(900, None), (901, ""), (902, " \n"), (903, "solo"), (903, "solo"), (904, "solo")]
    df = spark.createDataFrame([(*d, 0, "l") for d in docs], "doc_id long, text string, node int, label string")
    got = sorted(tuple(r) for r in jaccard.similarity_components(df, n, num, 100).collect())
    assert got == brute_components(docs, n, num)


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force_on_the_small_table(spark, n, num):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    got = sorted(tuple(r) for r in jaccard.similarity_components(docs, n, num).collect())
    assert got == brute_components([tuple(r) for r in docs.collect()], n, num)


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force_on_long_texts_around_the_threshold(spark, n, num):
    rnd = random.Random(n)
    docs = []
    for size in (700, 1500, 4000):
        base = [f"w{rnd.randrange(5000)}" for _ in range(size)]
        for k in range(14):
            words = list(base)
            for at in rnd.sample(range(size), int(size * (100 - num) / 100 / n * (0.1 + 0.08 * k))):
                words[at] = f"x{rnd.randrange(10**6)}"
            docs.append((len(docs), " ".join(words)))
    wanted = brute_components(docs, n, num)
    got = jaccard.similarity_components(spark.createDataFrame(docs, "doc_id long, text string"), n, num)
    assert sorted(tuple(r) for r in got.collect()) == wanted
    assert 3 < len({r[2] for r in wanted}) < len(docs)


def test_jaccard_with_every_frequent_key_split(spark, monkeypatch):
    """A group of near copies and one of exact copies, a third of all rows each, and parts of three rows a task."""
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    monkeypatch.setattr(jaccard, "PAIRS", 3)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join([f"v{i}", *base[1:]] if i % 2 else [*base[:-1], f"v{i}"])) for i in range(30)]
    docs += [(100 + i, "one and the same text in many rows") for i in range(30)]
    docs += [(200 + i, " ".join(f"r{rnd.randrange(400)}" for _ in range(60))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.similarity_components(df).collect())
    assert got == brute_components(docs) and len({r[2] for r in got}) == 32
    assert jaccard.near_duplicates(df, 3, 90).count() == 32


def test_spread_is_the_join(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 4)
    rows = spark.createDataFrame([(k, i) for k in (1, 2, None, 5) for i in range(k or 9)] + [(7, i) for i in range(40)], "k int, v int")
    keyed = spark.createDataFrame([(1, "a"), (5, "b"), (7, "c"), (8, "d")], "k int, w string")
    counts = rows.groupBy("k").agg(F.count("*").alias("n")).where("k is not null")
    for how in ("inner", "left"):
        wanted = sorted(rows.join(keyed, ["k"], how).collect(), key=repr)
        for known in (None, counts):
            assert sorted(shared.spread(rows, keyed, ["k"], counts=known, how=how).collect(), key=repr) == wanted
    dealt, sent, by = shared.parted(rows, keyed, ["k"])
    assert by == ["k", "_part_k"] and dealt.groupBy(*by).count().where("k = 7").count() == 10 == sent.where("k = 7").count()
    assert shared.spread(rows.limit(0), keyed, ["k"]).count() == 0


def test_kept_blocks_lose_hardly_any_link():
    """Differences dealt at random, as many as a link may have: the bound on the blocks that stay equal holds with room."""
    rng = np.random.default_rng(1)
    sizes = jaccard.Sizes(80, 100)
    sizes.extend(30_000)
    for low, m, kept, equal, need in zip(sizes.low, sizes.blocks, sizes.kept, sizes.equal, sizes.need):
        if m and kept < m:
            left = [kept - len(np.unique((d := rng.integers(0, m, m))[d < kept])) for _ in range(200)]
            assert min(left) > equal >= need and kept < 300 < low * 4


def test_near_duplicates_keep_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(200))
    docs = [(3, base, "a"), (1, base + " end", "b"), (2, "other words entirely here now", "c"), (2, "other words entirely here now", "c"), (None, base, "d"), (5, None, "e"), (6, "", "f")]
    df = spark.createDataFrame(docs, "doc_id long, text string, row string")
    left = jaccard.near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(left.collect(), key=repr) == sorted(df.where("row in ('b', 'e', 'f')").union(df.where("row = 'c'").limit(1)).collect(), key=repr)
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_kneser_ney_is_a_distribution(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat. the dog sat."), (2, "a cat and a dog"), (3, None)], "doc_id long, text string")
    model = quality.train(docs)
    import numpy as np

    sums = np.exp(model.log_p.astype(np.float64)).reshape(-1, quality.SYMBOLS).sum(1)
    assert np.allclose(sums, 1, atol=1e-4)
    assert model.perplexity("the cat sat") < model.perplexity("xqz 9#~ QQQ")


def test_quality_keeps_trusted_and_rejects_junk(spark):
    rows = {r["doc_id"]: r for r in queries.op5_quality(spark, SMALL).collect()}
    labels = table(spark, SMALL, "labels").collect()
    good = [rows[r["doc_id"]]["keep"] for r in labels if r["quality"] == 1]
    bad = [rows[r["doc_id"]]["keep"] for r in labels if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97
    assert sum(bad) / len(bad) < 0.25
    assert len(rows) == table(spark, SMALL, "documents").count()


ODD_NAMES = "doc_id long, text string, lang string, `a.b` int, row int, doc int, score int, keep int, _lm_row int"


def test_filters_pass_on_columns_of_any_name(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base if i < 3 else f"text {i} of its own kind", "en", *range(6)) for i in range(8)]
    docs = spark.createDataFrame(rows, ODD_NAMES)
    labels = spark.createDataFrame([(i, 1, int(i == 7)) for i in range(8)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "text 5 of its own kind")], "item_id long, text string")
    for out in (quality.keep_good(docs, labels), toxicity.keep_clean(docs, labels), decontaminate.keep_clean(docs, items), jaccard.near_duplicates(docs)):
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.collect()} <= set(rows)
    assert jaccard.near_duplicates(docs).count() == 6 and decontaminate.keep_clean(docs, items).count() == 7


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, 1), (2, "", "en", 1), (3, "some text", None, 1), (3, "some text", None, 1), (None, "zz", "x", 1)], "doc_id long, text string, lang string, lo int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(r["keep"] for r in quality.classify(docs, none).collect()) == [False, False, True, True, True]
    some = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, some)
    assert kept.columns == docs.columns and kept.where("doc_id = 3").count() == 2
    assert quality.classify(docs.limit(0), some).count() == 0


def test_toxicity_on_held_out_rows_of_the_larger_table(spark):
    rows = queries.op10_toxicity(spark, LARGER).join(table(spark, LARGER, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.03


def test_toxicity_on_held_out_rows(spark):
    scores = queries.op10_toxicity(spark, SMALL)
    rows = scores.join(table(spark, SMALL, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["toxic"] for r in rows]
    assert sum(right) / len(right) > 0.93
    assert scores.count() == table(spark, SMALL, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scores.collect())


def test_label_model_finds_how_accurate_voters_are():
    """Votes drawn from known accuracies, two of them the same voter; the posterior by Bayes' rule, text by text."""
    rng = np.random.default_rng(3)
    n, share = 4_000, 0.2
    y = rng.random(n) < share
    sure = (0.9, 0.85, 0.8, 0.75, 0.8)
    votes = np.stack([np.where(rng.random(n) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in sure], 1).astype(np.int8)
    votes = np.hstack([votes, votes[:, :1]])
    first = np.where(rng.random(n) < 0.85, y, ~y)
    model = toxicity.LabelModel.fit(votes, np.where(first, 0.95, 0.05))
    assert abs(model.share - share) < 0.02
    for j, a in enumerate(sure):
        assert abs(model.table[j, 1, 2] - a) < 0.03 and abs(model.table[j, 0, 0] - a) < 0.03
    assert model.correlation[0, 5] > 0.9 and abs(model.voice[0] - 0.5) < 0.05 and model.voice[1] > 0.9
    for row, p in zip(votes[:50], model.posterior(votes[:50])):
        one, two = model.share, 1 - model.share
        for j, v in enumerate(row):
            one *= model.table[j, 1, v + 1] ** model.voice[j]
            two *= model.table[j, 0, v + 1] ** model.voice[j]
        assert abs(p - one / (one + two)) < 1e-9


def test_logistic_regression_ends_on_separable_rows():
    rnd = np.random.default_rng(5)
    y = (np.arange(60) < 6).astype(np.float64)
    x = np.repeat(y[:, None], 20, axis=1).astype(np.float32) * rnd.integers(0, 2, (60, 20)).astype(np.float32)
    x[:, 0] = y
    w = toxicity.logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(w).max() < 30 and ((p >= 0.5) == (y > 0)).all()
    assert np.isfinite(toxicity.logistic(x[:1], y[:1])).all() and np.isfinite(toxicity.logistic(x, np.zeros(60))).all()


def test_toxicity_never_reads_labels_of_the_held_out_fold(spark):
    docs, labels = table(spark, TINY, "documents"), table(spark, TINY, "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = sorted(tuple(r) for r in toxicity.classify(docs, labels).collect())
    assert one == sorted(tuple(r) for r in toxicity.classify(docs, flipped).collect())


def test_shouting_is_judged_by_the_whole_text():
    lexicon = toxicity.Voters([])
    loud, quiet = "READ THIS NOW " * 200, "and then plain words " * 1_000
    assert lexicon.features(loud)[-1] == 1.0 and lexicon.features(quiet)[-1] == 0.0
    assert lexicon.features(loud + quiet)[-1] < 0.2
    assert lexicon.features(quiet[:2_100] + loud * 10)[-1] > 0.8
    assert lexicon.features("12 34 " * 10)[-1] == 0.0 and lexicon.features("HI")[-1] == 0.0


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "you idiot", 1.0), (3, "you idiot", 1.0), (None, "kind words", 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(docs, none).collect()
    assert len(rows) == 5 and {r["predicted"] for r in rows if r["doc_id"] == 3} == {1}
    assert toxicity.keep_clean(docs, none).count() == 3
    assert toxicity.classify(docs.limit(0), none).count() == 0


def test_licences_match_sql(spark):
    assert assert_same(queries.op7_licenses(spark, SMALL), queries.LICENSES_SQL, SMALL)


def test_licence_rules(spark):
    mit = [licenses.SENTENCES[k] for k in ("MIT-GRANT", "MIT-NOTICE", "AS-IS", "NO-LIABILITY")]
    words = " ".join(mit).split()
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    rows = {
        1: (None, "", 0), 2: ("", "", 0), 3: ("Released under the MIT License", "MIT", 1),
        4: ("header without stop\nLicensed under the Apache License, Version 2.0.\nmore", "Apache-2.0", 1),
        5: (": ".join([mit[0], ". ".join(mit[1:])]) + ".", "MIT", 4),
        6: ("Licensed under CC BY-NC 4.0. Something. This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0,GPL-3.0", 2),
        7: ("junk\n" + ".\n".join([": ".join([mit[0], mit[1]]), mit[2], mit[3]]) + ".", "MIT", 4),
        8: (licenses.SENTENCES["MIT-NOTICE"].replace(" ", "\n") + ".", "", 1),
        9: ("we like the mit license", "", 0),
    }
    docs = spark.createDataFrame([(k, v[0], "z") for k, v in rows.items()], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert {k: (r["licenses"], r["n_known"]) for k, r in got.items()} == {k: v[1:] for k, v in rows.items()}
    assert got[8]["unmatched"] == "MIT-NOTICE" and got[5]["unmatched"] == ""
    assert wrapped and licenses.scan(docs.limit(0)).count() == 0
