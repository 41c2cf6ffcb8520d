"""Quality rules against a brute-force version: plain counts, a dictionary Kneser-Ney model and sorted quantiles."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodemap.llm import quality_rules, queries
from lodemap.llm.shared import table
from tests.conftest import LARGER, TINY

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    words = WORD.findall(text)
    lines, earlier, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    hit = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


class BruteModel:
    def __init__(self, texts, order=5):
        self.order, self.n = order, {order: Counter()}
        for t in texts:
            x = "\x02" * (order - 1) + t + "\x03"
            self.n[order].update(x[i : i + order] for i in range(len(x) - order + 1))
        for k in range(order - 1, 0, -1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.d, self.context = {}, {k: defaultdict(list) for k in self.n}
        for k, counts in self.n.items():
            of = Counter(counts.values())
            n1, n2, n3, n4 = (max(1, of[i]) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            self.d[k] = [max(0.05, min(i - 0.05, v)) for i, v in enumerate(raw, 1)]
            for g, n in counts.items():
                self.context[k][g[:-1]].append(n)

    def p(self, gram):
        if not gram:
            return 1 / 65536
        k, n = len(gram), self.n[len(gram)].get(gram, 0)
        seen = self.context[k].get(gram[:-1])
        if not seen:
            return self.p(gram[1:])
        off = lambda c: self.d[k][min(c, 3) - 1]
        return ((n - off(n)) if n else 0) / sum(seen) + sum(map(off, seen)) / sum(seen) * self.p(gram[1:])

    def bits(self, text):
        x = "\x02" * (self.order - 1) + text + "\x03"
        places = range(len(x) - self.order + 1)
        return -sum(math.log(self.p(x[i : i + self.order])) for i in places) / len(places)


def brute(docs, labels):
    """docs of (doc_id, lang, text), labels of (doc_id, quality) to rows by document."""
    docs = [(i, lang or "", text or "") for i, lang, text in docs]
    good = {i for i, q in labels if q == 1 and i is not None}
    fold = lambda t: zlib.crc32(t.encode()) & 1
    texts = defaultdict(list)
    for i, lang, text in docs:
        if i in good:
            texts[fold(text), lang].append(text)
    models = {k: BruteModel(t) for k, t in texts.items()}
    none = BruteModel([])
    rows, seen = [], defaultdict(list)
    for i, lang, text in docs:
        counts = brute_base(text)
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        bits = models.get((1 - fold(text), lang), none).bits(text) if text else None
        rows.append((i, lang, counts, failed, bits))
        if i in good and not failed:
            seen[lang].append(round(bits, 4))

    def quantile(values, q):
        values, at = sorted(values), q * (len(values) - 1)
        return values[int(at)] + (at - int(at)) * (values[min(int(at) + 1, len(values) - 1)] - values[int(at)])

    out = []
    for i, lang, counts, failed, bits in rows:
        lo, mid, hi = (quantile(seen[lang], q) for q in (0.001, 0.5, 0.999)) if len(seen[lang]) >= quality_rules.LEAST else (None,) * 3
        inside = bits is None or lo is None or lo - 0.5 * (mid - lo) <= round(bits, 4) <= hi + 0.5 * (hi - mid)
        out.append((i, *counts, failed, not failed and inside, None if bits is None else round(math.exp(bits), 4)))
    return sorted(out, key=repr)


def rows_of(df):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity"]
    rows = df.select(*names).collect()
    return sorted(((*r[:-1], None if r[-1] is None else round(r[-1], 4)) for r in rows), key=repr)


def near(got, wanted):
    assert len(got) == len(wanted)
    for g, w in zip(got, wanted):
        assert g[:-1] == w[:-1]
        assert g[-1] == w[-1] or g[-1] == pytest.approx(w[-1], rel=1e-4)


def test_rules_equal_brute_force_on_the_table(spark, sf=TINY):
    docs = [(r["doc_id"], r["lang"], r["text"]) for r in table(spark, sf, "documents").collect()]
    labels = [(r["doc_id"], r["quality"]) for r in table(spark, sf, "labels").collect()]
    near(rows_of(queries.op11_quality_rules(spark, sf)), brute(docs, labels))


def odd_docs():
    docs = [(i, "en" if i % 3 else None, " ".join(f"w{(i * k) % 13}" for k in range(i % 40))) for i in range(120)]
    docs += [(None, "en", "null id " * 9), (130, "xx", None), (131, None, ""), (132, "en", " \n\t\n"), (133, "en", "\x02\x03\x1c \x85 　 🙂é" * 9)]
    docs += [(134, "en", "a b c d e f g h " * 5), (134, "en", "a b c d e f g h " * 5), (135, "en", "x " * 30), (136, "en", "one line\none line\n \n \none line")]
    return docs + [(137, "fr", " ".join(f"mot{i % 91}" for i in range(30_000)))]


@pytest.mark.parametrize(("held", "piece", "counted"), [(6_000_000, 400_000, 400_000), (300, 50, 20)])
def test_odd_rows_equal_brute_force(spark, monkeypatch, held, piece, counted):
    """Nulls, empty and very long texts, repeated rows and labels, clashing columns; also in many shards and pieces."""
    for name, value in (("HELD", held), ("PIECE", piece), ("COUNTED", counted), ("LEAST", 5)):
        monkeypatch.setattr(quality_rules, name, value)
    docs = odd_docs()
    labels = [(i, int(i % 4 > 0)) for i in range(0, 120)] * 2 + [(None, 1), (137, 1), (134, None), (4, 1)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumns({"id": F.lit("z"), "n_words": F.lit(0), "quality": F.lit(9), "model": F.lit(1)})
    got = quality_rules.apply_rules(df.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int"))
    near(rows_of(got), brute(docs, labels))


def test_empty_tables_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    marks = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.apply_rules(none, marks).count() == 0
    some = spark.createDataFrame([(1, "en", " ".join(map(str, range(30)))), (2, "en", "short")], none.schema)
    assert {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(some, marks).collect()} == {1: True, 2: False}


def test_bands_tell_good_from_bad(spark):
    """Of the labelled rows of the larger table that pass the base rules; no text is scored by a model that saw it."""
    marks = table(spark, LARGER, "labels").select("doc_id", "quality")
    rows = queries.op11_quality_rules(spark, LARGER).where("not base_failed").join(marks, "doc_id")
    share = {r["quality"]: r["share"] for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.99 and share[0] < 0.05
