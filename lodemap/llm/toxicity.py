"""Toxicity by weak supervision.

Voters are lexicons and patterns.  The lexicon is a short list of insults and the
word beginnings that labelled rows show to go with toxic text (a log-likelihood
test against all other beginnings).  Each voter says toxic, clean or nothing of a
text.  A generative label model estimates, by expectation maximisation, how accurate
each voter is, and from what is left of their agreement how they correlate;
correlated voters share one voice.  Labels only give the first guess of how accurate
the voters are: a label is no voter, and what the model says of a text follows from
its votes alone.  These posterior labels train a linear classifier on the voters'
features, which scores every whole text.

Only labels of rows outside the held-out fold are read.  Labels, language, source
and id are never inputs of a score.  The fit uses at most TRAIN_ROWS rows (a
documented bound, taken by hash of the id); scoring is one pass without a shuffle.

Null and empty texts are scored by the intercept alone.  Without labels the listed
insults decide.  Labels that are null are ignored; a document with several labels
is toxic if any says so.  Repeated rows get equal scores.  All other columns are
passed on as they are, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import sized, slices, stored

TRAIN_ROWS = 12_000
#: Lengths of the word beginnings that are tested.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A beginning counts only if so many, and this share, of the toxic rows have it, and this share of its rows is toxic.
LEAST_ROWS, LEAST_SHARE, LEAST_PRECISION = 5, 0.012, 0.9
LABELS_BROADCAST = 1_000_000
FOLDS = 5
#: Insults that vote toxic without any labels.
INSULTS = {
    "en": "idiot moron stupid loser scum trash clown worthless pathetic disgusting dumbass imbecile scumbag retard",
    "de": "idiot dummkopf abschaum arschloch widerlich trottel versager",
    "fr": "idiot imbécile ordure connard salaud débile abruti",
    "es": "idiota imbécil basura estúpido escoria asqueroso cabrón",
}
LETTERS = r"[^\p{L}]+"


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod FOLDS; fold 0 is held out. A null id is in fold 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(1))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic int) of at most TRAIN_ROWS labelled rows outside the held-out fold."""
    narrow = (
        labels.where(F.col("toxic").isNotNull() & (fold(F.col(id_col)) != 0))
        .groupBy(F.col(id_col).alias("_lm_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    )
    narrow = narrow.orderBy(F.xxhash64("_lm_id"), "_lm_id").limit(TRAIN_ROWS)
    narrow = stored(narrow, "toxic-labels")
    rows = docs.select(F.col(id_col).alias("_lm_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(sized(narrow, narrow.count(), LABELS_BROADCAST), "_lm_id").select("text", "toxic")


def stems(rows: DataFrame) -> list[str]:
    """Word beginnings that go with toxic rows, the most frequent first.

    Each stands in LEAST_SHARE of the toxic rows at least, so there are at most as
    many of them as a toxic row has beginnings, by that share.
    """
    words = rows.select("toxic", F.array_distinct(F.split(F.lower("text"), LETTERS)).alias("w"))
    starts = F.array_distinct(F.flatten(F.array(*[F.transform("w", _cut(k)) for k in BEGINNINGS])))
    seen = words.select("toxic", F.explode(starts).alias("stem")).where(F.length("stem") >= BEGINNINGS[0])
    totals = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    n, pos = totals["n"], totals["pos"] or 0
    if not pos or pos == n:
        return []
    base = pos / n
    counts = seen.groupBy("stem").agg(F.sum("toxic").alias("a"), F.count("*").alias("c"))
    rate = F.least(F.lit(0.999), F.col("a") / F.col("c"))
    gain = F.col("a") * F.ln(rate / base) + (F.col("c") - F.col("a")) * F.ln((1 - rate) / (1 - base))
    tested = counts.where((F.col("a") >= max(LEAST_ROWS, LEAST_SHARE * pos)) & (F.col("a") > LEAST_PRECISION * F.col("c"))).withColumn("gain", gain)
    found = tested.collect()
    least = math.log(max(2, counts.where("a > 0").count())) + 3
    kept: list[tuple[str, int, int]] = []
    for r in sorted((r for r in found if r["gain"] >= least), key=lambda r: (len(r["stem"]), r["stem"])):
        under = [k for k in kept if r["stem"].startswith(k[0])]
        if not any(k[1] / k[2] >= r["a"] / r["c"] - 0.02 for k in under):  # nothing new to its beginning
            kept.append((r["stem"], r["a"], r["c"]))
    return [k[0] for k in sorted(kept, key=lambda k: (-k[1], k[0]))]


def _cut(k: int):
    return lambda x: F.left(x, F.lit(k))


class Voters:
    """Features of a text: hits of each lexicon entry at word starts, and counts of patterns."""

    PATTERNS = ("!!", "??", "***", "$$$", "#")

    def __init__(self, learned: list[str]):
        self.listed = sorted({w for words in INSULTS.values() for w in words.split()})
        self.entries = self.listed + [s for s in learned if s not in set(self.listed)]
        self.finder = None

    def __getstate__(self):
        return {"listed": self.listed, "entries": self.entries, "finder": None}

    @property
    def names(self) -> list[str]:
        return [*self.entries, "any lexicon entry", "two lexicon entries", "hits per 100 words", *self.PATTERNS, "shouting"]

    def features(self, text: str) -> np.ndarray:
        if self.finder is None:
            import ahocorasick

            self.finder = ahocorasick.Automaton()
            for i, e in enumerate(self.entries):
                self.finder.add_word(e, (i, len(e), e in set(self.listed)))
            self.finder.make_automaton()
        low = text.lower()
        out = np.zeros(len(self.names), np.float32)
        n = len(self.entries)
        hits = 0
        for end, (i, size, whole) in self.finder.iter(low):
            start = end - size
            if (start >= 0 and low[start].isalpha()) or (whole and end + 1 < len(low) and low[end + 1].isalpha()):
                continue
            out[i] = 1.0
            hits += 1
        out[n] = hits > 0
        out[n + 1] = hits > 1
        words = text.count(" ") + text.count("\n") + 1
        out[n + 2] = min(1.0, 10 * hits / words)
        for k, p in enumerate(self.PATTERNS):
            out[n + 3 + k] = min(1.0, 5 * text.count(p) / words)
        capitals = sum(map(str.isupper, text))
        out[-1] = capitals / max(1, capitals + sum(map(str.islower, text)))
        return out

    def votes(self, x: np.ndarray) -> np.ndarray:
        """1 toxic, -1 clean, 0 nothing: a column for each lexicon entry and pattern, and voters for clean."""
        n = len(self.entries)
        toxic = (x[:, : n + 2] > 0).astype(np.int8)
        patterns = (x[:, n + 3 :] > 0.5).astype(np.int8)
        quiet = -(x[:, n : n + 1] == 0).astype(np.int8)
        no_listed = -(x[:, : len(self.listed)].sum(1, keepdims=True) == 0).astype(np.int8)
        rare = -(x[:, n + 2 : n + 3] < 0.02).astype(np.int8)
        return np.hstack([toxic, patterns, quiet, no_listed, rare])


@dataclass
class LabelModel:
    """Naive generative model of votes: class share, P(vote | class) of each voter, and how much of a voice it has."""

    share: float = 0.1
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3)))
    voice: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.table)
        at = votes.astype(np.int64) + 1
        score = np.full(len(votes), math.log(self.share / (1 - self.share)))
        for j in range(votes.shape[1]):
            score += self.voice[j] * (logs[j, 1, at[:, j]] - logs[j, 0, at[:, j]])
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))

    @classmethod
    def fit(cls, votes: np.ndarray, first: np.ndarray, rounds: int = 25) -> LabelModel:
        """Expectation maximisation from first probabilities; then from these again, with correlated voters sharing a voice."""
        n, v = votes.shape
        model = cls(voice=np.ones(v), correlation=np.eye(v))
        onehot = np.stack([votes == k for k in (-1, 0, 1)], 2).astype(np.float64)
        for again in range(2):
            p = first
            for _ in range(rounds):
                model.share = float(np.clip(p.mean(), 0.01, 0.6))
                weights = np.stack([1 - p, p], 1)
                table = np.einsum("nc,nvk->vck", weights, onehot) + 0.5
                model.table = table / table.sum(2, keepdims=True)
                p = model.posterior(votes)
            if again:
                break
            # What voters still share within a class is correlation, not evidence.
            left = votes - (np.stack([1 - p, p], 1) @ (model.table @ np.array([-1.0, 0.0, 1.0])).T)
            spread = np.sqrt((left**2).mean(0)) + 1e-6
            model.correlation = (left.T @ left) / n / np.outer(spread, spread)
            np.fill_diagonal(model.correlation, 1.0)
            strong = np.abs(model.correlation)
            model.voice = 1 / np.where(strong > 0.3, strong, 0).sum(1)
        return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression on soft labels.

    Newton's method whose steps are halved until the penalised loss falls: with few
    rows and separable labels a whole step overshoots and never comes back.
    """
    z = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(z.shape[1])
    w[-1] = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    ridged = np.full(len(w), ridge)
    ridged[-1] = 1e-3

    def loss(at: np.ndarray) -> float:
        s = z @ at
        return float((np.logaddexp(0.0, s) - y * s).sum() + 0.5 * (ridged * at * at).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridged), z.T @ (y - p) - ridged * w)
        size = 1.0
        while size > 1e-6 and not (then := loss(w + size * step)) <= now:
            size /= 2
        if size <= 1e-6:
            break
        w, fell, now = w + size * step, now - then, then
        if fell < 1e-9 * (1 + abs(now)):
            break
    return w


@dataclass
class Classifier:
    voters: Voters
    weights: np.ndarray
    label_model: LabelModel

    def score(self, text: str | None) -> float:
        if not text:
            return float(1 / (1 + math.exp(-self.weights[-1])))
        s = float(self.voters.features(text) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Lexicon, label model and classifier from a bounded sample of labelled rows outside the held-out fold."""
    rows = stored(labelled(docs, labels, id_col, text_col), "toxic-rows")
    voters = Voters(stems(rows))
    size = len(voters.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [voters.features(t.as_py()).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], ["x", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(run, "x binary, toxic int").collect()  # TRAIN_ROWS rows at most
    x = np.frombuffer(b"".join(r["x"] for r in found), np.float32).reshape(-1, size)
    if not len(x):  # nothing to learn from: the listed insults decide
        weights = np.zeros(size + 1)
        weights[len(voters.entries)], weights[-1] = 6.0, -3.0
        return Classifier(voters, weights, LabelModel())
    votes = voters.votes(x)
    model = LabelModel.fit(votes, np.where([r["toxic"] for r in found], 0.95, 0.05))
    return Classifier(voters, logistic(x, model.posterior(votes)), model)


def scored(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """(doc struct, score double): whole rows, whatever their columns are called, and their scores."""
    schema = docs.select(F.struct("*").alias("doc"), F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in slices(batches):
            found = pa.array([c.score(t.as_py()) for t in batch.column(0).field(text_col)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc", "score"])

    return docs.select(F.struct("*").alias("doc")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out boolean, score double, predicted int) for every row."""
    classifier = train(docs, labels, id_col, text_col)
    return scored(docs.select(id_col, text_col), classifier, text_col).select(
        F.col("doc")[id_col].alias(id_col),
        (fold(F.col("doc")[id_col]) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    return scored(docs, train(docs, labels, id_col, text_col), text_col).where("score < 0.5").select("doc.*")
