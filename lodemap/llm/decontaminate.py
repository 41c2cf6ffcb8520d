"""Benchmark decontamination with a distributed positional inverted index.

The index stores a posting (row, term, position) for each occurrence of a term of
the test items in the training texts, and one posting of an end-of-text term that
holds the text's length.  A phrase is found by intersecting offset-adjusted
lists: a posting of a term at item position p votes for the alignment
``position - p`` of the item with the text.  The lists of the rarest term of each
window give the candidate alignments, those of the second rarest term thin them
out, and only for what is left are the lists of all terms intersected.  Runs of
consecutive agreeing positions are then the exact phrase matches.

DataFrame functions only.  Texts are tokenised once and never shuffled; what is
shuffled are candidates.  A term with a third of all postings is never an anchor
unless a window has nothing rarer, and then its join is on (row, position, term),
which has no hot key.

Words are runs of ASCII letters, digits and non-ASCII characters after lower-
casing A-Z.  Null and empty texts have no words and no hits; items without words
never match.  Each row of the input gives one row, also where ids repeat or are
null.  Repeated items with one id count once.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, numbered, sized, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: The term whose posting holds the number of words of a text; no word contains it.
END = "\x00"
WINDOW = 10


@dataclass
class Index:
    """``postings``: (row long, id, term long, pos int); ``id`` is only kept with the end-of-text posting."""

    postings: DataFrame

    def docs(self) -> DataFrame:
        """(row, id, n_words long): every indexed text."""
        return self.postings.where(F.col("term") == F.xxhash64(F.lit(END))).select("row", "id", F.col("pos").cast("long").alias("n_words"))


def tokens(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, pos, word): the words of each text in order, then END at the position after the last."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    at_start = (text == "") | F.substring(text, 1, 1).rlike(SEPARATORS)
    at_end = (text != "") & F.substring(text, -1, 1).rlike(SEPARATORS)
    words = F.concat(F.split(text, SEPARATORS + "+"), F.array(F.lit(END)))
    return (
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            at_start.cast("int").alias("_lead"),
            at_end.cast("int").alias("_trail"),
            words.alias("_words"),
        )
        .select("row", "id", "_lead", "_trail", F.posexplode("_words").alias("_at", "_word"))
        .select(
            "row",
            "id",
            (F.col("_at") - F.col("_lead") - F.when(F.col("_word") == END, F.col("_trail")).otherwise(0)).alias("pos"),
            ascii_lower(F.col("_word")).alias("word"),
        )
    )


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item long, item_id string, p int, n int, word, term long) of the test items."""
    parts = stored(tokens(items, id_col, text_col), "items")
    ends = parts.where(F.col("word") == END).select(F.col("row").alias("item"), F.col("pos").alias("n"))
    words = parts.where((F.col("word") != END) & (F.col("word") != "")).select(
        F.col("row").alias("item"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("item_id"), F.col("pos").alias("p"), "word"
    )
    return stored(words.join(ends, "item").withColumn("term", F.xxhash64("word")), "item-terms")


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Stores the postings of all words, or of those in ``terms`` (word, term), which is what items can ask for."""
    words = tokens(docs, id_col, text_col)
    end = F.col("word") == END
    kept_id = F.when(end, F.col("id")).alias("id")
    if terms is None:
        postings = words.where(F.col("word") != "").select("row", kept_id, F.xxhash64("word").alias("term"), "pos")
    else:
        spark = docs.sparkSession
        known = terms.select("word", "term").distinct().unionByName(
            spark.range(1).select(F.lit(END).alias("word"), F.xxhash64(F.lit(END)).alias("term"))
        )
        known = stored(known.withColumnRenamed("word", "_known"), "terms")
        postings = words.withColumn("term", F.xxhash64("word")).join(sized(known, known.count()), "term").where(
            F.col("word") == F.col("_known")
        )
        postings = postings.select("row", kept_id, "term", "pos")
    return Index(stored(postings, "postings"))


def phrases(index: Index, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches of the windows of ``items`` (from ``item_terms``): (row, item_id, start, end), inclusive spans.

    A span is a maximal run of at least ``window`` words (or of all of a shorter
    item) that the text shares with the item at one alignment.
    """
    postings = index.postings
    counts = postings.groupBy("term").agg(F.count("*").alias("freq"))
    known = stored(items.join(counts, "term").select("item", "item_id", "p", "n", "term", "freq"), "item-frequencies")

    # The two rarest positions of every window all of whose words occur.
    first = F.greatest(F.lit(0), F.col("p") - window + 1)
    last = F.least(F.col("p"), F.greatest(F.lit(0), F.col("n") - window))
    windows = (
        known.select("item", "p", "n", "term", "freq", F.explode(F.sequence(first, last)).alias("o"))
        .groupBy("item", "o")
        .agg(F.min("n").alias("n"), F.sort_array(F.collect_list(F.struct("freq", "p", "term"))).alias("by_freq"))
        .where(F.size("by_freq") == F.least(F.lit(window), F.col("n")))
        .select("item", F.col("by_freq")[0].alias("a"), F.coalesce(F.get("by_freq", F.lit(1)), F.col("by_freq")[0]).alias("b"))
        .select("item", F.col("a.p").alias("p1"), F.col("a.term").alias("term1"), F.col("b.p").alias("p2"), F.col("b.term").alias("term2"))
        .distinct()
    )
    windows = stored(windows, "windows")
    anchors = windows.select("item", "p1", F.col("term1").alias("term")).distinct()
    candidates = stored(
        postings.join(sized(anchors, anchors.count()), "term").select("row", "item", "p1", (F.col("pos") - F.col("p1")).alias("diag")),
        "candidates",
    )
    seconds = windows.select(F.col("term2").alias("term")).distinct()
    listed = postings.join(sized(seconds, seconds.count()), "term", "left_semi").select("row", "term", "pos")
    asked = candidates.join(sized(windows.drop("term1"), windows.count()), ["item", "p1"]).select(
        "row", "item", "diag", F.col("term2").alias("term"), (F.col("diag") + F.col("p2")).alias("pos")
    )
    left = stored(asked.join(listed, ["row", "pos", "term"]).select("row", "item", "diag").distinct(), "alignments")

    rows = left.select("row").distinct()
    listed = postings.join(sized(rows, rows.count()), "row", "left_semi").select("row", "term", "pos")
    asked = left.join(sized(known, known.count()), "item").select(
        "row", "item", "item_id", "diag", "n", "p", "term", (F.col("diag") + F.col("p")).alias("pos")
    )
    agreed = asked.join(listed, ["row", "pos", "term"]).select("row", "item", "item_id", "diag", "n", "p")
    order = Window.partitionBy("row", "item", "diag").orderBy("p")
    return (
        agreed.withColumn("run", F.col("p") - F.row_number().over(order))
        .groupBy("row", "item", "item_id", "diag", "n", "run")
        .agg(F.min("p").alias("p"), F.count("*").alias("length"))
        .where(F.col("length") >= F.least(F.lit(window), F.col("n")))
        .select(
            "row",
            "item_id",
            (F.col("diag") + F.col("p")).alias("start"),
            (F.col("diag") + F.col("p") + F.col("length") - 1).cast("int").alias("end"),
        )
        .distinct()
    )


def proximity(index: Index, items: DataFrame, width: int) -> DataFrame:
    """(row, item_id, start, end): stretches of ``width`` words from ``start`` that hold all distinct words of an item.

    The rarest word of an item decides which texts are looked at; in those, the
    item's lists are merged by position.
    """
    bags = items.select("item", "item_id", "term").distinct()
    counts = index.postings.groupBy("term").agg(F.count("*").alias("freq"))
    known = bags.join(counts, "term", "left")
    per = known.groupBy("item").agg(
        F.count("*").alias("words"), F.min(F.struct(F.coalesce("freq", F.lit(0)), "term")).alias("rare"), F.count("freq").alias("found")
    )
    per = stored(per.where("words = found").select("item", "words", F.col("rare.term").alias("rare")), "rarest")
    texts = index.postings.join(per.select("item", F.col("rare").alias("term")), "term").select("row", "item").distinct()
    lists = bags.join(per.select("item", "words"), "item")
    hits = index.postings.join(lists, "term").join(texts, ["row", "item"], "left_semi").select("row", "item", "item_id", "words", "term", "pos")
    ahead = Window.partitionBy("row", "item").orderBy("pos").rangeBetween(0, width - 1)
    return (
        hits.withColumn("near", F.size(F.collect_set("term").over(ahead)))
        .where("near = words")
        .select("row", "item_id", F.col("pos").alias("start"), (F.col("pos") + width - 1).alias("end"))
        .distinct()
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id_col, n_words, n_hit, n_items long, items_sha256 string, contaminated boolean) for every row of ``docs``."""
    items = item_terms(benchmark, item_col, item_text_col)
    index = build_index(docs, items, id_col, text_col)
    spans = stored(phrases(index, items, window), "spans")
    hit = (
        spans.select("row", "start", "end").distinct()
        .select("row", F.explode(F.sequence("start", "end")).alias("pos")).distinct()
        .groupBy("row").agg(F.count("*").alias("n_hit"))
    )
    found = spans.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("found"))
    ids = F.coalesce(F.col("found"), F.array().cast("array<string>"))
    n_hit: Column = F.coalesce(F.col("n_hit"), F.lit(0))
    return (
        index.docs()
        .join(hit, "row", "left")
        .join(found, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            n_hit.alias("n_hit"),
            F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
        )
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark passage, with all their columns; decided row by row, also where ids repeat or are null."""
    rows = numbered(docs)
    texts = rows.select("row", F.col("doc")[text_col].alias("text"))
    judged = decontaminate(texts, benchmark, window, "row", "text", item_col, item_text_col)
    gone = stored(judged.where("contaminated").select("row"), "contaminated")
    return rows.join(sized(gone, gone.count()), "row", "left_anti").select("doc.*")
