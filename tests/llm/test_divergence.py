"""Source divergence against SQL and a brute-force version in Python's integers."""

import re
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from lodemap.llm import divergence, queries
from tests.compare import assert_same
from tests.conftest import SMALL, TINY

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs):
    """docs of (lang, source, text) to the sorted rows of the audit."""
    docs = [tuple(x or "" for x in d) for d in docs]
    out = []
    for lang in {d[0] for d in docs}:
        held, counts = Counter(), defaultdict(Counter)
        for _, source, text in (d for d in docs if d[0] == lang):
            words = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            counts[source].update(words)
            held.update(set(words))
        kept = [w for w, n in held.items() if n >= 3]
        whole = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (total + len(kept)) for w in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(whole)
        pairs = [(s, "pair", t, sum((p[s][w] - p[t][w]) ** 2 // p[t][w] for w in kept)) for s, t in product(p, p) if s != t]
        terms = [(s, "term", w, (p[s][w] - q[w]) ** 2 // q[w]) for s in p for w in kept if counts[s][w] and p[s][w] > q[w]]
        for s, part in product(p, ("pair", "term")):
            rows = sorted((x for x in pairs + terms if x[:2] == (s, part)), key=lambda x: (-x[3], x[2].encode()))
            out += [(lang, *x, rank) for rank, x in enumerate(rows, 1) if part == "pair" or rank <= 200]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("sf", [TINY, SMALL])
def test_audit_equals_sql(spark, sf):
    assert assert_same(queries.op12_divergence(spark, sf), queries.oracle_sql()["op12_divergence"], sf) > 1000


def odd_rows():
    rows = [("en", f"s{i % 4}", " ".join(f"W{chr(97 + (i * j) % 17)}é" for j in range(i % 7 + 1))) for i in range(60)]
    rows += [(None, None, None), (None, "a", "x X x"), ("", "b", "x y"), ("", "", "x"), ("fr", "s0", ""), ("fr", "s1", "12 34"), ("de", "only", "a b c")]
    return rows + [("en", "s1", "same text here")] * 40 + [("en", "long", "ab1" * 40_000), ("en", "s9", None), ("zz", "s0", "日本 İ ǅ 日本")] * 3


@pytest.mark.parametrize(("cells", "block", "dense", "held"), [(200_000, 512, 1_000_000, 300_000), (5, 2, 7, 3)])
def test_odd_rows_equal_brute_force(spark, monkeypatch, cells, block, dense, held):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns; also with many salts, blocks and pieces."""
    for name, value in (("SALT_CELLS", cells), ("BLOCK", block), ("DENSE", dense), ("HELD", held), ("TOP", 3)):
        monkeypatch.setattr(divergence, name, value)
    rows = odd_rows()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    df = df.withColumns({"term": F.lit(1), "vec": F.lit("v"), "n": F.lit(0), "rank": F.lit(0)}).repartition(3)
    wanted = [r for r in brute(rows) if r[2] == "pair" or r[5] <= 3]
    assert rows_of(divergence.audit(df)) == wanted


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_are_exact_for_huge_counts():
    import numpy as np

    counts = np.array([0, 10**15, 9 * 10**18 // 10**9])
    assert divergence.share(counts, 3 * 10**15, 7).tolist() == [1 + 10**9 * (int(c) + 1) // (3 * 10**15 + 7) for c in counts]
