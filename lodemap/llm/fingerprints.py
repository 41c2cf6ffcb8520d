"""Document fingerprints by I-Match with randomised lexicons.

Document frequencies of all terms give the lexicon: the terms whose inverse
document frequency lies in a chosen band.  A text's distinct terms (as 64-bit ids)
are hashed for several lexicons: slot 0 takes those in the band, or all if none is;
slot r takes the smallest lexicon of the r-th random family in which the text still
has a term.  A family holds all terms in a random order and each of its lexicons
lacks the last term of the one before; a term of the band stands ``BAND_WEIGHT``
times as far in front as another.  So terms of the band decide where a text has
them, and the others where it has few or none, as in a group of copies that holds
so many of the documents that its terms are above the band.  Equal texts have equal
fingerprints, and a text that shares a share of its terms with another agrees in
about that share of the slots.

DataFrame functions only.  The lexicon is bounded: a text of d distinct terms adds
d to the sum of all frequencies, so with a least share p of the documents there
are at most (mean d)/p terms, whatever the size of the corpus.

Null text counts as empty.  No text loses terms, whatever its length; without any
terms it is fingerprinted by its own hash.  Repeated rows each give a row.  Ids may be of any kind
that has an order.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .decontaminate import SEPARATORS
from .shared import sized, stored

#: The band: terms in at least and at most these shares of the documents.
LOW_SHARE, HIGH_SHARE = 0.001, 0.1
#: Random lexicon families; a fingerprint has one slot more.
FAMILIES = 16
SLOT = 12
#: How much more a term of the band counts than another; a power of two.
BAND_WEIGHT = 4
#: Documents are put in order in blocks of about so many rows, of which there are at most BLOCKS.
BLOCK_ROWS, BLOCKS = 4_000, 2_000
LEXICON_BROADCAST = 500_000


def distinct_terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), SEPARATORS + "+"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW_SHARE, high: float = HIGH_SHARE) -> DataFrame:
    """(term): the terms of all documents in the band of inverse document frequency."""
    words = docs.select(F.explode(distinct_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    counts = words.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    n = docs.count()
    return stored(counts.where((F.col("df") >= max(2, low * n)) & (F.col("df") <= max(2, high * n))).select("term"), "lexicon")


def rank(term: Column, known: Column, family: int) -> Column:
    """The place of a term id in the random order of a family."""
    h = F.xxhash64(term, F.lit(family)).bitwiseAND(F.lit((1 << 62) - 1))
    return F.when(known, F.shiftright(h, BAND_WEIGHT.bit_length() - 1)).otherwise(h)


def slot(hashed: Column) -> Column:
    return F.lpad(F.substring(F.lower(F.hex(hashed)), 1, SLOT), SLOT, "0")


def likeness(a: Column, b: Column) -> Column:
    """1 if the whole fingerprints agree, else the share of equal slots among the random families."""
    starts = F.array(*[F.lit(1 + SLOT * (r + 1)) for r in range(FAMILIES)])
    same = F.size(F.filter(starts, lambda s: a.substr(s, F.lit(SLOT)) == b.substr(s, F.lit(SLOT))))
    return F.when(a == b, F.lit(1.0)).otherwise(same.cast("double") / F.lit(float(FAMILIES)))


def numeric_edges(docs: DataFrame, id_col: str, count: int) -> list:
    return docs.agg(F.percentile_approx(id_col, [i / count for i in range(1, count)], 10 * count)).first()[0] or []


def spread_edges(docs: DataFrame, id_col: str, count: int) -> list:
    """Block edges for ids of any kind that has an order: even ranks among the ids with the smallest hashes, ten a block.

    Edges decide only where blocks end, not what is in the result.
    """
    some = docs.select(F.col(id_col).alias("id")).where("id is not null").orderBy(F.xxhash64("id")).limit(10 * count)
    ids = [r["id"] for r in some.orderBy("id").collect()]
    return [ids[len(ids) * i // count] for i in range(1, count)] if ids else []


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents in descending order of id: (block, ghost, id, text).

    Block boundaries are ids.  Each block also gets, as ghosts at its end, the
    first document of the block that follows; the last block gets the first of
    all.  So a window over a block sees the next document of each of its own.
    """
    facts = docs.agg(F.count("*").alias("n"), F.max(id_col).alias("top")).first()
    count = min(BLOCKS, -(-facts["n"] // BLOCK_ROWS))
    edges = []
    if count > 1:
        found = numeric_edges(docs, id_col, count) if isinstance(docs.schema[id_col].dataType, NumericType) else spread_edges(docs, id_col, count)
        edges = sorted(set(found) - {facts["top"]})
    kind = dict(docs.dtypes)[id_col]
    listed = F.array(*[F.lit(e) for e in edges]).cast(f"array<{kind}>")
    key = F.col(id_col)
    own = F.size(F.filter(listed, lambda e: e < key)) if edges else F.lit(0)
    follows = F.array_position(listed, key).cast("int") if edges else F.lit(0)
    places = F.array_compact(
        F.array(
            F.struct(own.alias("block"), F.lit(False).alias("ghost")),
            F.when(F.coalesce(follows, F.lit(0)) > 0, F.struct(follows.alias("block"), F.lit(True).alias("ghost"))),
            F.when(key.eqNullSafe(F.lit(facts["top"]).cast(kind)), F.struct(F.lit(0).alias("block"), F.lit(True).alias("ghost"))),
        )
    )
    return docs.select(
        F.explode(places).alias("_place"), key.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")
    ).select("_place.block", "_place.ghost", "id", "text", "row")


def fingerprint(texts: DataFrame, known: DataFrame, keys: list[str], text_cols: list[str]) -> DataFrame:
    """Adds ``<text>_print`` for each text column; ``keys`` identify a row and are all that is kept.

    If ``texts`` is partitioned by some of the keys nothing is shuffled.
    """
    n = known.count()
    each = [
        F.struct(F.lit(i).alias("which"), F.concat(distinct_terms(F.col(c)), F.array(F.lit(""))).alias("terms"), F.xxhash64(c).alias("whole"))
        for i, c in enumerate(text_cols)
    ]
    rows = texts.select(*keys, F.explode(F.array(*each)).alias("_t")).select(*keys, "_t.which", "_t.whole", F.explode("_t.terms").alias("term"))
    rows = rows.join(sized(known.withColumn("known", F.lit(True)), n, LEXICON_BROADCAST), "term", "left")
    rows = rows.select(*keys, "which", "whole", (F.col("term") != "").alias("word"), F.xxhash64("term").alias("term"), F.coalesce("known", F.lit(False)).alias("known"))
    facts = []
    for i in range(len(text_cols)):
        mine = (F.col("which") == i) & F.col("word")
        band = mine & F.col("known")
        facts += [
            F.max(F.when(F.col("which") == i, F.col("whole"))).alias(f"_whole{i}"),
            F.count_if(mine).alias(f"_all{i}"),
            F.count_if(band).alias(f"_band{i}"),
            F.bit_xor(F.when(mine, F.col("term"))).alias(f"_all_terms{i}"),
            F.bit_xor(F.when(band, F.col("term"))).alias(f"_band_terms{i}"),
            *[F.min(F.when(mine, rank(F.col("term"), F.col("known"), r))).alias(f"_first{i}_{r}") for r in range(FAMILIES)],
        ]
    out = rows.groupBy(*keys).agg(*facts)

    def printed(i: int) -> Column:
        terms = F.when(F.col(f"_band{i}") > 0, F.xxhash64(f"_band{i}", f"_band_terms{i}")).otherwise(F.xxhash64(f"_all{i}", f"_all_terms{i}"))
        parts = [slot(terms), *(slot(F.xxhash64(f"_first{i}_{r}")) for r in range(FAMILIES))]
        return F.when(F.col(f"_all{i}") > 0, F.concat(*parts)).otherwise(F.repeat(slot(F.col(f"_whole{i}")), FAMILIES + 1))

    return out.select(*keys, *[printed(i).alias(f"{c}_print") for i, c in enumerate(text_cols)])


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of the text with its last third replaced by the start of the next document's, and how alike they are.

    Returns (id_col, n_chars long, edited_sha256, fingerprint, edited_fingerprint
    string, near_edited, near_next double).  The next document is the one before
    in order of id; after the last comes the first.  Null ids come last.
    """
    known = lexicon(docs, text_col)
    order = Window.partitionBy("block").orderBy(F.col("ghost"), F.col("id").desc_nulls_last(), F.col("row"))
    size = F.char_length("text")
    cut = F.floor(size / 3).cast("int")
    rows = (
        in_order(docs, id_col, text_col)
        .withColumn("next", F.lead("text").over(order))
        .withColumn("edited", F.concat(F.col("text").substr(F.lit(1), size - cut), F.coalesce(F.col("next"), F.lit("")).substr(F.lit(1), cut)))
        .select("block", "ghost", "row", "id", size.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "edited")
    )
    prints = fingerprint(rows, known, ["block", "ghost", "row", "id", "n_chars", "edited_sha256"], ["text", "edited"])
    prints = prints.withColumn("next_print", F.lead("text_print").over(order)).where(~F.col("ghost"))
    return prints.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        F.col("text_print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("text_print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("text_print"), F.col("next_print")).alias("near_next"),
    )
