"""Ranks and quantiles over ranges against sorted lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemap.operators import ordering


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([rnd.randint(-5, 5), rnd.random(), None]), i) for i in range(3000)] + [("c", 7, -1), ("d", None, -2)]
    data = [(g, None if x is None else float(x), i) for g, x, i in data]
    return data, spark.createDataFrame(data, "g string, x double, i long").repartition(7).cache()


@pytest.mark.parametrize("few", [200_000, 0])
def test_quantiles_by_group(spark, rows, few, monkeypatch):
    monkeypatch.setattr(ordering, "FEW", few)
    data, df = rows
    shares = [0, 0.05, 0.25, 1 / 3, 0.5, 0.95, 1]
    got = {r["g"]: (r["total"], r["q"]) for r in ordering.quantiles(df, "x", shares, ["g"]).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, (n, q) in got.items():
        x = [v for k, v, _ in data if k == g and v is not None]
        assert n == len(x) and q == pytest.approx(np.quantile(x, shares).tolist())


@pytest.mark.parametrize("few", [200_000, 0])
def test_quantiles_of_all_and_of_nothing(spark, rows, few, monkeypatch):
    monkeypatch.setattr(ordering, "FEW", few)
    data, df = rows
    x = [v for _, v, _ in data if v is not None]
    assert ordering.quantiles(df, "x", [0.5]).first()["q"] == pytest.approx([float(np.median(x))])
    assert ordering.quantiles(df.where("x > 100"), "x", [0.5]).count() == 0


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_ranks(spark, rows, groups, monkeypatch):
    data, df = rows
    for limit in (ordering.COUNTS, 0):
        monkeypatch.setattr(ordering, "COUNTS", limit)
        got = {r["i"]: (r["rank"], r["_total"]) for r in ordering.ranked(df, [F.col("x"), F.col("i")], groups).collect()}
        by = {}
        for g, x, i in data:
            by.setdefault(g if groups else 0, []).append((x is not None, x or 0.0, i))
        assert got == {i: (k, len(v)) for v in by.values() for k, (*_, i) in enumerate(sorted(v))}


def test_no_single_task_holds_all(spark, rows):
    plan = ordering.ranked(rows[1], ["x", "i"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
