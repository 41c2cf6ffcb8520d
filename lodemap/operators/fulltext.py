"""Positional full-text index over chunks: postings by term, questions with and, or, not and phrases, BM25.

``build`` writes three tables.  A posting is a row of (term, chunk, length of the chunk,
position).  Each task sorts the postings of its own chunks by term into a segment (by
the term's hash, ``place``: numbers are sorted without comparing rows), so
nothing is shuffled but the chunks, a term that a third of all chunks hold is many rows in
many files, and a question reads the pages of its own terms only.  What a question
gathers of a chunk is a count for each of its terms, and positions for those in phrases.

Words are runs of letters and digits in lower case; their ends are cut by the first
steps of Porter's rules; stop words are not indexed but keep their place, so that
phrases count over them.  Null and empty texts have no postings.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
WORD = r"([\p{L}\p{N}]+)"

# Words of English that are not indexed.
STOP = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below",
    "between", "both", "but", "by", "can", "did", "do", "does", "doing", "don", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have",
    "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "me", "more",
    "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "s",
    "same", "she", "should", "so", "some", "such", "t", "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this",
    "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will",
    "with", "you", "your", "yours", "yourself", "yourselves",
)


#: Ends of words and what they become, one after the other: plurals, -ed and -ing (with an e or one of two consonants), y after a vowel.
PLURAL = ("(?:(?:(?<=ss)|(?<=i))es|(?<=[^sui])s)$", "")
WHOLE = ("(at|iz|[aeiouy].*bl)(?:ing|ed)$", "$1e")
BARE = (r"([aeiouy].*?)(?:(?<=([bdfgmnprt]))\2)?(?:ing|ed)$", "$1")
VOWEL_Y = ("([aeiouy].*)y$", "$1i")


def stem(word: Column) -> Column:
    """A word without the ends of plurals, -ed and -ing; y after a vowel's syllable is i. Short words stay.

    Rules for -ing and -ed are tried on words that have these ends, maybe before an s.
    """
    single = F.regexp_replace(word, *PLURAL)
    whole = F.regexp_replace(F.regexp_replace(single, *WHOLE), *BARE)
    inflected = word.endswith("ing") | word.endswith("ed") | word.endswith("ings") | word.endswith("eds")
    ends = F.when(F.length(word) <= 3, word).when(inflected, F.regexp_replace(whole, *VOWEL_Y))
    return ends.when(word.endswith("s") | word.endswith("y"), F.regexp_replace(single, *VOWEL_Y)).otherwise(word)


@dataclass(frozen=True)
class Index:
    """Where an index lies, what names a chunk and which columns a scope may ask for."""

    path: str
    keys: tuple[str, ...]
    scope: tuple[str, ...] = ()

    def read(self, spark: SparkSession, part: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{part}")


def build(chunks: DataFrame, path: str, keys: Sequence[str] = ("doc_id", "chunk"), text_col: str = "text", scope: Sequence[str] = (), stop: Sequence[str] = STOP) -> Index:
    """Writes the chunks, the postings with the lengths of their chunks and the sums over all chunks under ``path``."""
    named = [*keys, *scope]
    spark, index = chunks.sparkSession, Index(path, tuple(keys), tuple(scope))
    chunks.repartition(*keys).write.mode("overwrite").parquet(f"{path}/chunks")
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), 1)
    # Stems are made inside the array: as columns of exploded rows they make one method with sort and explode that Java doesn't compile.
    terms = F.transform(words, lambda w: F.when(~w.isin(*stop), stem(w)) if stop else stem(w))
    placed = index.read(spark, "chunks").select(*named, terms.alias("_terms"))
    sized = placed.select(*named, "_terms", F.size(F.filter("_terms", lambda t: t.isNotNull())).alias("n_terms"))
    # Not outer, Spark would find the words again to ask whether there are any.
    postings = sized.select(*named, "n_terms", F.posexplode_outer("_terms").alias("pos", "term")).where("term is not null").withColumn("place", F.xxhash64("term"))
    postings.sortWithinPartitions("place").write.mode("overwrite").parquet(f"{path}/postings")
    facts = index.read(spark, "chunks").agg(F.count("*").alias("chunks")).crossJoin(index.read(spark, "postings").agg(F.count("*").alias("terms")))  # one row each
    facts.write.mode("overwrite").parquet(f"{path}/facts")
    return index


def parsed(question: str) -> list[list[tuple[bool, list[str]]]]:
    """A question as search pages take it: words are all needed, ``or`` parts what may be, ``-`` is not, quotes hold phrases.

    Alternatives of (excluded, words of a phrase); ``or`` binds less than the words beside it.
    """
    ways: list[list[tuple[bool, list[str]]]] = [[]]
    for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', question):
        if word.lower() == "or" and not sign:
            ways.append([])
            continue
        words = re.findall(r"[^\W_]+", (phrase or word).lower())
        if words:
            ways[-1].append((bool(sign), words))
    return [w for w in ways if w]


def search(spark: SparkSession, index: Index, question: str, k: int | None = None, within: Column | None = None, stop: Sequence[str] = STOP) -> DataFrame:
    """(keys, score): chunks that answer a question, best first if ``k`` is given; ``within`` is a condition on the scope columns.

    Stop words of a question are left out, in phrases they stand for any word.  A way
    that only excludes is answered by all chunks without what it excludes.
    """
    keys = list(index.keys)
    ways = parsed(question)
    asked = sorted({w for way in ways for _, words in way for w in words if w not in stop})
    stems = dict(zip(asked, spark.range(1).select(F.array(*[stem(F.lit(w)) for w in asked]).alias("s")).first()["s"])) if asked else {}
    chunks = index.read(spark, "chunks")
    scoped = chunks.where(within) if within is not None else chunks
    none = scoped.select(*keys, F.lit(0.0).alias("score")).where(F.lit(False))
    ways = [[(no, [stems.get(w) for w in words]) for no, words in way if any(w in stems for w in words)] for way in ways]
    ways = [w for w in ways if w]
    if not ways:
        return none
    terms = sorted(set(stems.values()))
    placed = {w for way in ways for _, words in way if sum(map(bool, words)) > 1 for w in words if w}
    number = {t: i for i, t in enumerate(terms)}
    held = index.read(spark, "postings").where(F.col("place").isin(*[F.xxhash64(F.lit(t)) for t in terms]) & F.col("term").isin(*terms))
    here = {t: F.col("term") == t for t in terms}
    tfs = [F.count_if(here[t]).alias(f"_n{number[t]}") for t in terms]
    counted = held.groupBy(*keys, *index.scope).agg(*tfs)
    dfs = counted.agg(*[F.count_if(F.col(f"_n{number[t]}") > 0).alias(f"_n{number[t]}") for t in terms]).first()
    facts = index.read(spark, "facts").first()
    wanted = sorted({w for way in ways for no, words in way if not no for w in words if w})
    if within is not None:
        held = held.where(within)
    at = [F.collect_list(F.when(here[t], F.col("pos"))).alias(f"_at{number[t]}") for t in sorted(placed)]
    rows = held.groupBy(*keys).agg(F.max("n_terms").alias("n_terms"), *tfs, *at)
    if any(all(no for no, _ in way) for way in ways):
        rows = scoped.select(*keys).join(rows, keys, "left").fillna(0, ["n_terms", *[f"_n{i}" for i in number.values()]])
    else:
        rows = rows.dropna(subset=keys)

    def phrase(words: list[str | None]) -> Column:
        there = [(i, w) for i, w in enumerate(words) if w]
        (first, w), rest = there[0], there[1:]
        at = lambda t: F.coalesce(F.col(f"_at{number[t]}"), F.array().cast("array<int>"))
        ok = lambda p: _all(F.array_contains(at(t), p + (i - first)) for i, t in rest)
        return F.exists(at(w), ok) if rest else F.col(f"_n{number[w]}") > 0

    match = None
    for way in ways:
        one = _all(~phrase(words) if no else phrase(words) for no, words in way)
        match = one if match is None else match | one
    mean = max(1.0, (facts["terms"] or 0) / max(1, facts["chunks"]))
    score: Column = F.lit(0.0)
    for t in wanted:
        tf, df = F.col(f"_n{number[t]}"), dfs[f"_n{number[t]}"]
        idf = F.ln(F.lit(1 + (facts["chunks"] - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_terms") / mean))
    out = rows.where(match).select(*keys, score.alias("score"))
    return out.orderBy(F.round("score", 6).desc(), *reversed(keys)).limit(k) if k else out


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out
