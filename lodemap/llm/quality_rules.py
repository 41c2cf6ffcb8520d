"""Quality rules: counts of words, signs and repeats, then bands of n-gram perplexity.

A text fails the base rules with fewer than ``LEAST_WORDS`` words or if more than
``MOST_REPEATED`` percent of its words lie in ``WINDOW``-word windows that the text
holds more than once.  Others are judged by their perplexity under an interpolated
modified Kneser-Ney model of characters (order ``ORDER``) of their language: lower
and upper bands come from the trusted texts of that language.

The model is counted by Spark over all trusted texts: tasks sum up n-grams, which
meet by model and n-gram; lower orders count distinct left neighbours; totals,
discounts and back-off weights are joined to the n-grams by context and the lower
probability by suffix.  What comes out is stored as sorted arrays of 64-bit hashes
beside arrays of logarithms, and looked up by binary search, once for each distinct
n-gram of a slice of texts.

No text is scored by a model that has seen it: texts are dealt to two folds by
their checksum (equal texts to the same one), each with its own model, and take the
other's.  The model grows with the trusted text.  Up to ``HELD`` entries it goes to
the tasks whole; beyond that it is cut by the two characters before the predicted
one into shards of about so many entries, which are applied one after the other,
and the sums of a text are added up.

Null text is empty, null languages are ''.  Where a language has fewer than
``LEAST`` trusted texts the base rules alone decide.  Labels that repeat a document
count once; one label of quality 1 makes a document trusted, null ids never are.  Repeated rows are
judged alike, each gets its row; very long texts are scored in pieces and
count whole.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sized, slices, stored, trusted

LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
ORDER = 5
#: Quantiles of trusted texts, how far they are widened, and the least number of texts they come from.
LOW, HIGH, MARGIN, LEAST = 0.001, 0.999, 0.5, 40
#: The probability that the empty context gives any character.
UNIFORM = 1 / 65_536
#: Entries of the arrays that a task holds; code points of a slice that are scored at once; n-grams that a task counts before it hands them on.
HELD, PIECE, COUNTED = 6_000_000, 400_000, 400_000
#: Code points whose n-grams a task counts at once (texts of a slice and pieces of long ones; at least PIECE of one text); n-grams in a batch that it hands on.
COUNTED_AT_ONCE, TOLD = 200_000, 50_000
#: Fixed odd multipliers of the hash.
TIMES, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
START, END = "\x02", "\x03"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows that occur twice or more."""
    if len(words) <= WINDOW:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(words) - WINDOW + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * TIMES + ids[k : k + n]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0  # equal windows have equal hashes
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    size = 1
    while size < WINDOW:  # ranks of windows of twice the size are those of pairs
        _, rank = np.unique(rank[:-size] * (len(words) + 1) + rank[size:], return_inverse=True)
        size *= 2
    twice = np.bincount(rank)[rank] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[WINDOW:] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


def base(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); bytes.split() cuts at ASCII blanks only, as words are defined."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def fold_of(text: str) -> int:
    return zlib.crc32(text.encode()) & 1


def points(text: str) -> Iterator[np.ndarray]:
    """Code points with start and end marks in overlapping pieces: each n-gram's last place is in one of them."""
    x = np.frombuffer((START * (ORDER - 1) + text + END).encode("utf-32-le"), "<u4").astype(np.uint64)
    for low in range(0, len(x) - ORDER + 1, PIECE):
        yield x[low : low + PIECE + ORDER - 1]


def seed(model: str, order: int) -> int:
    return int.from_bytes(hashlib.md5(f"{order}:{model}".encode()).digest()[:8], "little")


def hashed(x: np.ndarray, order: int, seeds: np.ndarray | np.uint64) -> np.ndarray:
    """Hashes of the ``order`` points before each of the last places of x's rows (its last axis)."""
    h = np.zeros(x.shape[:-1], np.uint64)
    for k in range(x.shape[-1] - order, x.shape[-1]):
        h = (h + x[..., k] + np.uint64(1)) * TIMES
    h = (h + seeds) * MIX
    return h ^ (h >> np.uint64(29))


def windows(x: np.ndarray) -> np.ndarray:
    """(places, ORDER): the n-grams of a piece."""
    return np.lib.stride_tricks.sliding_window_view(x, ORDER)


def count_grams(docs: DataFrame) -> DataFrame:
    """(model, gram string, n long): n-grams of order ORDER of (lang, text) by fold and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}

        def met(pieces: list[tuple]) -> tuple:
            keys, grams, n = (np.concatenate(x) for x in zip(*pieces))
            keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, back, n)
            return keys, grams[first], total

        def told() -> Iterator[pa.RecordBatch]:
            for model in list(held):
                _, grams, n = met(held.pop(model))
                for low in range(0, len(n), TOLD):
                    some = n[low : low + TOLD]
                    whole = grams[low : low + TOLD].tobytes().decode("utf-32-le")
                    names = pa.repeat(pa.scalar(model, pa.string()), len(some))
                    cut = pa.array([whole[i : i + ORDER] for i in range(0, len(whole), ORDER)], pa.string())
                    yield pa.RecordBatch.from_arrays([names, cut, pa.array(some, pa.int64())], ["model", "gram", "n"])

        def add(model: str, x: list[np.ndarray]) -> None:
            grams = np.concatenate([windows(p) for p in x])
            keys, first, n = np.unique(hashed(grams, ORDER, np.uint64(0)), return_index=True, return_counts=True)
            pieces = held.setdefault(model, [])
            pieces.append((keys, grams[first].astype("<u4"), n))
            if sum(len(p[0]) for p in pieces) > COUNTED:
                held[model] = [met(pieces)]

        def flush(here: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for model, x in here.items():
                add(model, x)
            here.clear()
            if sum(len(p[0]) for ps in held.values() for p in ps) > 4 * COUNTED:
                yield from told()

        for batch in slices(batches, 100):
            here, size = {}, 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                model = f"{fold_of(text)}{lang}"
                for x in points(text):
                    if size + len(x) > COUNTED_AT_ONCE:
                        yield from flush(here)
                        size = 0
                    here.setdefault(model, []).append(x)
                    size += len(x)
            yield from flush(here)
        yield from told()

    out = docs.select("lang", "text").mapInArrow(run, "model string, gram string, n long")
    return out.groupBy("model", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> DataFrame:
    """(kind, model, gram string, value float), written: logarithms of probabilities ('p') of n-grams and of back-off weights ('b') of contexts."""
    grams = {ORDER: stored(count_grams(docs), "grams")}
    for k in range(ORDER - 1, 0, -1):  # distinct left neighbours
        grams[k] = stored(grams[k + 1].groupBy("model", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), "grams")
    facts = None
    for k, g in grams.items():
        n = [F.greatest(F.lit(1), F.count_if(F.col("n") == i)).alias(f"n{i}") for i in (1, 2, 3, 4)]
        one = g.groupBy("model").agg(*n).withColumn("k", F.lit(k))
        facts = one if facts is None else facts.unionByName(one)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    cut = [F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))).alias(f"d{i}") for i in (1, 2, 3)]
    facts = stored(facts.select("model", "k", *cut), "discounts")
    models = facts.count() // ORDER
    lower, out = None, None
    for k in range(1, ORDER + 1):
        g = grams[k].withColumn("context", F.substring("gram", 1, k - 1))
        own = sized(facts.where(F.col("k") == k).drop("k"), models)
        seen = [F.count_if(F.col("n") == i).alias(f"c{i}") for i in (1, 2)] + [F.count_if(F.col("n") >= 3).alias("c3")]
        off = F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")
        contexts = g.groupBy("model", "context").agg(F.sum("n").alias("total"), *seen).join(own, "model")
        contexts = stored(contexts.select("model", "context", "total", "d1", "d2", "d3", (off / F.col("total")).alias("back")), "contexts")
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = g.join(contexts, ["model", "context"]).withColumn("suffix", F.substring("gram", 2, k - 1))
        rows = rows.withColumn("low", F.lit(UNIFORM)) if lower is None else rows.join(lower, ["model", "suffix"])
        p = stored(rows.select("model", "gram", ((F.col("n") - less) / F.col("total") + F.col("back") * F.col("low")).alias("p")), "probabilities")
        lower = p.select("model", F.col("gram").alias("suffix"), F.col("p").alias("low"))
        both = p.select(F.lit("p").alias("kind"), "model", "gram", F.ln("p").cast("float").alias("value")).unionByName(
            contexts.select(F.lit("b").alias("kind"), "model", F.col("context").alias("gram"), F.ln("back").cast("float").alias("value"))
        )
        out = both if out is None else out.unionByName(both)
    return stored(out, "model")


@dataclass
class Arrays:
    """Sorted hashes of n-grams and of contexts, with their logarithms, of one shard of the model."""

    p_keys: np.ndarray
    p: np.ndarray
    b_keys: np.ndarray
    b: np.ndarray
    shard: int
    shards: int

    def scores(self, grams: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """Logarithm of each row's last point after the others; seeds: (rows, ORDER + 1)."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, 0, -1):
            at, hit = found(self.p_keys, hashed(grams[left], k, seeds[left, k]))
            out[left[hit]] += self.p[at[hit]]
            left = left[~hit]
            at, hit = found(self.b_keys, hashed(grams[left, :-1], k - 1, seeds[left, k - 1]))
            out[left[hit]] += self.b[at[hit]]
        out[left] += np.log(UNIFORM)
        return out


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def shard_of(before: np.ndarray, shards: int) -> np.ndarray:
    """The shard by the two points before the predicted one (the last axis)."""
    return hashed(before, 2, np.uint64(7)) % np.uint64(shards)


def arrays(model: DataFrame, shard: int, shards: int) -> Arrays:
    """One shard of the model: tasks hash and sort their entries, about HELD of which meet here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100_000):
            kinds, models, grams, values = (c.to_pylist() if i < 3 else c.to_numpy() for i, c in enumerate(batch.columns))
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            keys, keep = np.zeros(len(grams), np.uint64), np.ones(len(grams), bool)
            first = np.array([k == "p" for k in kinds], bool)
            seeds = {(m, k): seed(m, k) for m, k in set(zip(models, sizes.tolist()))}
            mixed = np.array([seeds[m, k] for m, k in zip(models, sizes.tolist())], np.uint64)
            for k in range(ORDER + 1):
                here = np.flatnonzero(sizes == k)
                x = np.frombuffer("".join(grams[i] for i in here).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(len(here), k)
                keys[here] = hashed(x, k, mixed[here])
                for p in (True, False):
                    rows = first[here] == p
                    before = x[rows][:, : k - 1] if p else x[rows]
                    if before.shape[1] >= 2:
                        keep[here[rows]] = shard_of(before, shards) == shard
            for p in (True, False):
                rows = np.flatnonzero(keep & (first == p))
                rows = rows[np.argsort(keys[rows])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p]), pa.array([keys[rows].tobytes()], pa.binary()), pa.array([values[rows].astype(np.float32).tobytes()], pa.binary())], ["p", "keys", "value"]
                )

    held: dict[bool, tuple] = {}
    pieces = model.mapInArrow(run, "p boolean, keys binary, value binary").collect()
    for p in (True, False):
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in pieces if r["p"] == p)])
        value = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r["value"], np.float32) for r in pieces if r["p"] == p)])
        order = np.argsort(keys)
        held[p] = keys[order], value[order]
    return Arrays(*held[True], *held[False], shard, shards)


def sums(texts: list[tuple[str, str]], lm: Arrays) -> np.ndarray:
    """Sums of the logarithms of all characters and the end of (lang, text) that fall into the shard."""
    total = np.zeros(len(texts))
    held: list[tuple[int, np.ndarray]] = []
    seeds: dict[str, np.ndarray] = {}
    models = []
    for lang, text in texts:
        models.append(m := f"{1 - fold_of(text)}{lang}")
        if m not in seeds:
            seeds[m] = np.array([seed(m, k) for k in range(ORDER + 1)], np.uint64)

    def flush() -> None:
        if not held:
            return
        grams = np.concatenate([windows(x) for _, x in held])
        sizes = [len(x) - ORDER + 1 for _, x in held]
        owner = np.repeat([i for i, _ in held], sizes)
        of = np.repeat(np.arange(len(held)), sizes)
        table = np.stack([seeds[models[i]] for i, _ in held])
        if lm.shards > 1:
            here = np.flatnonzero(shard_of(grams[:, :-1], lm.shards) == lm.shard)
            grams, owner, of = grams[here], owner[here], of[here]
        _, first, back = np.unique(hashed(grams, ORDER, table[of, ORDER]), return_index=True, return_inverse=True)
        total[:] += np.bincount(owner, lm.scores(grams[first], table[of[first]])[back], len(total))
        held.clear()

    size = 0
    for i, (_, text) in enumerate(texts):
        for x in points(text):
            if size + len(x) > PIECE:
                flush()
                size = 0
            held.append((i, x))
            size += len(x)
    flush()
    return total


def measured(rows: DataFrame, lm: Arrays) -> DataFrame:
    """(id, lang, the base counts, mark binary, logs double): ``mark`` names the text, ``logs`` is its sum in this shard."""
    shared = rows.sparkSession.sparkContext.broadcast(lm)
    names = ["id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "mark", "logs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            texts = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            # the counts of a text are taken with the first shard only
            counts = [(*base(t), len(t)) if lm_first else (0,) * 6 for _, t in texts]
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(6)]
            marks = pa.array([hashlib.md5(t.encode()).digest() for _, t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, marks, pa.array(sums(texts, shared.value), pa.float64())], names)

    lm_first = lm.shard == 0
    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "lang", "text").mapInArrow(run, f"id {kind}, lang string, {', '.join(f'{n} long' for n in names[2:8])}, mark binary, logs double")


def scored(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(id, lang, the base counts, n_chars, logs) of every row, written."""
    shards = max(1, -(-model.count() // HELD))
    out = stored(measured(rows, arrays(model, 0, shards)), "measured")
    if shards == 1:
        return out
    more = [out.select("lang", "mark", F.lit(0).alias("shard"), "logs")]
    for s in range(1, shards):
        more.append(stored(measured(rows, arrays(model, s, shards)).select("lang", "mark", F.lit(s).alias("shard"), "logs"), "measured"))
    logs = more[0]
    for m in more[1:]:
        logs = logs.unionByName(m)
    logs = logs.groupBy("lang", "mark", "shard").agg(F.max("logs").alias("logs")).groupBy("lang", "mark").agg(F.sum("logs").alias("logs"))
    return stored(out.drop("logs").join(logs, ["lang", "mark"]), "scored")


def bands(seen: DataFrame) -> DataFrame:
    """(lang, lo, hi): bands of the logarithm of perplexity, from exact quantiles of (lang, bits) at four decimals."""
    q = F.percentile(F.round("bits", 4), F.array(F.lit(LOW), F.lit(0.5), F.lit(HIGH)))
    return (
        seen.groupBy("lang")
        .agg(q.alias("q"), F.count("*").alias("n"))
        .where(F.col("n") >= LEAST)
        .select("lang", (F.col("q")[0] - MARGIN * (F.col("q")[1] - F.col("q")[0])).alias("lo"), (F.col("q")[2] + MARGIN * (F.col("q")[2] - F.col("q")[1])).alias("hi"))
    )


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long, base_failed, kept boolean, perplexity, low, high double) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (text_col, "text"))])
    marks = labels.select(F.col(id_col).alias("id"), "quality")
    model = train(trusted(rows, marks, "id"))
    found = scored(rows, model).withColumn("bits", F.when(F.col("n_chars") > 0, -F.col("logs") / (F.col("n_chars") + 1)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    good = trusted(found.where(~failed).select("id", "lang", "bits"), marks, "id")
    band = stored(bands(good), "bands")
    out = found.join(sized(band, band.count()), "lang", "left")
    inside = F.coalesce(F.round("bits", 4).between(F.col("lo"), F.col("hi")), F.lit(True))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(
        F.col("id").alias(id_col), *counts, failed.alias("base_failed"), (~failed & inside).alias("kept"), *[F.exp(c).alias(n) for c, n in (("bits", "perplexity"), ("lo", "low"), ("hi", "high"))]
    )
