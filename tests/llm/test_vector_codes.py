"""Vector codes against SQL and a brute-force version in Python's integers."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lodemap.llm import queries, vector_codes
from lodemap.llm.shared import table
from tests.compare import assert_same
from tests.conftest import SMALL, TINY


def brute(rows):
    """rows of (vec_id, label, vector) to (codes by row, label errors, digest)."""
    kept = [(i, y, v) for i, y, v in rows if v is not None and all(x is not None and abs(x) <= 3.4028234663852886e38 for x in v)]
    width = max(1, -(-max((len(v) for *_, v in kept), default=0) // 16))
    whole = [(i, y, [math.floor(Fraction(x) * 256) for x in v] + [0] * (16 * width - len(v)), v) for i, y, v in kept]
    start = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:64]
    parts = [[tuple(w[k * width : (k + 1) * width]) for _, _, w, _ in whole] for k in range(16)]
    books = [[tuple(w[k * width : (k + 1) * width]) for _, _, w, _ in start] for k in range(16)]

    def best(point, book):
        return min((sum((a - b) ** 2 for a, b in zip(point, c)), e) for e, c in enumerate(book))

    for _ in range(2):
        for k in range(16):
            found = {}
            for p in parts[k]:
                found.setdefault(best(p, books[k])[1], []).append(p)
            books[k] = [tuple(sum(x) // len(found[e]) for x in zip(*found[e])) if e in found else c for e, c in enumerate(books[k])]
    last = [[best(parts[k][n], books[k]) for k in range(16)] for n in range(len(whole))]
    error = [sum(d for d, _ in row) for row in last]
    by_label = Counter()
    for (_, y, _, _), e in zip(whole, error):
        by_label[y] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((w[0], "".join(f"{e:02x}" for _, e in row), s, by_label[w[1]], digest) for w, row, s in zip(whole, last, error)), key=repr)


def test_codes_equal_sql(spark):
    assert assert_same(queries.op13_vector_codes(spark, SMALL), queries.oracle_sql()["op13_vector_codes"], SMALL) == 500


def test_codes_equal_brute_force_on_the_table(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table(spark, TINY, "embeddings").collect()]
    assert sorted((tuple(r) for r in queries.op13_vector_codes(spark, TINY).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("size", [32, 37, 5])
def test_odd_rows(spark, size):
    """Nulls, non-finite components, ties, repeated rows and ids, uneven and huge vectors, clashing columns."""
    rows = [(i % 90, i % 3 if i % 4 else None, [((i * 7 + j * 13) % 11 - 5) / 4 for j in range(size)]) for i in range(100)]
    rows += [(None, 1, [0.5] * size), (None, None, [0.25] * size), (3, 2, None), (4, 2, [None] * size), (5, 2, [float("nan")] * size), (6, 2, [float("inf")] + [0.0] * (size - 1))]
    rows += [(200, 1, []), (201, 1, [1.0]), (200, 1, []), (202, 0, [-(2.0**60)] + [1.0] * (size - 1)), (203, 0, [3e38] * size), (204, 0, [1e39] * size)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"code": F.lit(1), "id": F.lit("x"), "v": F.lit(0), "_lm_label": F.lit(0)})
    wanted = [(*r[:2], *(x if x < 2**63 else None for x in r[2:4]), r[4]) for r in brute(rows)]
    got = sorted((tuple(r) for r in vector_codes.compress(df.repartition(5)).collect()), key=repr)
    assert [(g[0], g[1], g[2], g[4]) for g in got] == [(w[0], w[1], w[2], w[4]) for w in wanted]
    assert [g[3] for g in got if g[3] is not None] == [w[3] for w in wanted if w[3] is not None]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vector_codes.compress(none).count() == 0
    bad = spark.createDataFrame([(1, 1, None), (2, 1, [None])], none.schema)
    assert vector_codes.compress(bad).count() == 0


def test_a_code_gives_its_entries_back(spark):
    coded, books = vector_codes.encode(table(spark, TINY, "embeddings"))
    source = {r["vec_id"]: r["embedding"] for r in table(spark, TINY, "embeddings").collect()}
    for r in coded.collect():
        back = vector_codes.lookup(r["code"], books)
        assert sum((math.floor(x * 256) - c) ** 2 for x, c in zip(source[r["vec_id"]], back)) == r["error"]
