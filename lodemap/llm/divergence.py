"""Source divergence audit: which sources of a language speak differently, and by which terms.

Terms are runs of letters (A-Z lower-cased, other characters beyond ASCII as they
are).  A language keeps the terms of at least ``LEAST_DOCS`` of its documents.  A
term's share of a group or language is ``1 + floor(10^9 (count + 1) / (N + V))``
and a pair differs in it by ``floor((p - q)^2 / q)``.

Terms with the same counts in the same sources differ alike, so each language's
terms are grouped by their sparse vector of (source, count).  Every pair of
sources is evaluated once for each distinct vector and multiplied by the number of
its terms; the strongest vectors of a group then give their original terms back.

Counting is done in the tasks and met by (language, term); vectors are dealt by
language and salt, so a source or language with a third of all rows is split.  A
task holds the sums of ``BLOCK`` sources against all others of their language.

All arithmetic is exact: shares stay below 2^30 + 2 and the sums over a language
below 2^62, counts beyond int64 products are reckoned in Python's integers.
Null text, lang and source count as ''.  A group without terms takes part with
zero counts; a language without kept terms has pairs of value 0 and no terms.
Repeated rows are documents of their own, whole texts are read, ties rank by item
in UTF-8 order.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import sized, slices, stored

LEAST_DOCS, TOP, BILLION = 3, 200, 1_000_000_000
#: The term pattern ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` on lower-cased UTF-8: bytes.lower() takes A-Z only.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: A task hands its counts on when it holds so many terms.
HELD = 300_000
#: Cells (source, count) of a salt's vectors, sources whose pairs a task sums up, and cells of a dense piece.
SALT_CELLS, BLOCK, DENSE = 200_000, 512, 1_000_000


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term string, n, docs long) of (lang, source, text), summed in each task."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple, Counter] = defaultdict(Counter)
        rows: dict[tuple, Counter] = defaultdict(Counter)

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in times.items():
                size = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(lang, pa.string()), size), pa.repeat(pa.scalar(source, pa.string()), size), pa.array(found, pa.binary()).cast(pa.string()),
                        pa.array(found.values(), pa.int64()), pa.array(map(rows[lang, source].__getitem__, found), pa.int64()),
                    ],
                    names,
                )
            times.clear()
            rows.clear()

        for batch in slices(batches, 100):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                words = TERM.findall(text.as_py().lower())
                times[lang, source].update(words)
                rows[lang, source].update(set(words))
            if sum(map(len, times.values())) > HELD:
                yield from told()
        yield from told()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, term, vec array<struct<source, n>>) of the kept terms: written."""
    met = counted(docs).repartition("lang", "term")
    by_source = met.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vec = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec")
    return stored(by_source.groupBy("lang", "term").agg(vec, F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs"), "terms")


def group_facts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, n, n_lang, kept long): every group that occurs, its count over kept terms, its language's, and V."""
    groups = docs.select("lang", "source").distinct()
    sums = terms.select("lang", F.explode("vec").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    both = stored(groups.join(sums, ["lang", "source"], "left").fillna(0, ["n"]), "groups")
    totals = both.groupBy("lang").agg(F.sum("n").alias("n_lang")).join(terms.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").fillna(0, ["kept"])
    totals = stored(totals, "languages")
    return both.join(sized(totals, totals.count()), "lang")


def share(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + kept)), exact for any counts."""
    up = count + 1
    if up.size and up.max() > (1 << 62) // BILLION:
        up = up.astype(object)
    return (1 + up * BILLION // (total + kept)).astype(np.int64)


def strongest(values: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Indexes of the vectors whose terms may be among the first TOP: all of the last value that is needed too."""
    order = np.argsort(-values, kind="stable")
    last = np.searchsorted(np.cumsum(times[order]), TOP)
    return np.flatnonzero(values >= values[order[min(last, len(order) - 1)]])


def evaluated(vectors: DataFrame, facts: DataFrame) -> DataFrame:
    """(lang, source, item, value, vec): partial sums of pairs (vec null) and each group's strongest vectors (item null).

    ``vectors`` has (lang, vec, times); a language's are dealt by salt, its facts go to each salt.
    """
    kind = dict(vectors.dtypes)["vec"]
    cells = vectors.groupBy("lang").agg(F.sum(F.size("vec")).alias("cells"))
    deal = facts.groupBy("lang").agg(F.floor((F.count("*") - 1) / BLOCK).alias("blocks")).join(cells, "lang", "left")
    deal = stored(deal.select("lang", "blocks", F.ceil(F.greatest(F.coalesce("cells", F.lit(1)), F.lit(1)) / SALT_CELLS).alias("salts")), "deal")
    langs = sized(deal, deal.count())
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), "blocks")).alias("block")
    left = vectors.join(langs, "lang").select("lang", "vec", "times", F.pmod(F.xxhash64("vec"), "salts").alias("salt"), blocks)
    right = facts.join(langs, "lang").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).select("lang", "source", "n", "n_lang", "kept", "salt", blocks)

    def run(key: tuple, vecs: pa.Table, groups: pa.Table) -> pa.Table:
        lang, _, block = (k.as_py() for k in key)
        groups = groups.sort_by("source")
        names = groups.column("source").combine_chunks()
        n, size = groups.column("n").to_numpy(), len(names)
        n_lang, kept = groups.column("n_lang")[0].as_py(), groups.column("kept")[0].as_py()
        own = range(block * BLOCK, min(size, (block + 1) * BLOCK))
        total = np.zeros((len(own), size), np.int64)
        vec, times = vecs.column("vec").combine_chunks(), vecs.column("times").to_numpy()
        ends, parts = vec.offsets.to_numpy(), vec.flatten()
        at, counts = pc.index_in(parts.field("source"), value_set=names).to_numpy(), parts.field("n").to_numpy()
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        step = max(1, DENSE // size)
        for low in range(0, len(vec), step):
            high = min(len(vec), low + step)
            here = slice(ends[low] - ends[0], ends[high] - ends[0])
            dense = np.zeros((high - low, size), np.int64)
            dense[np.repeat(np.arange(high - low), np.diff(ends[low : high + 1])), at[here]] = counts[here]
            p = np.stack([share(dense[:, k], int(n[k]), kept) for k in range(size)], 1)
            q = share(dense.sum(1), n_lang, kept)
            for i, k in enumerate(own):
                off = p[:, k : k + 1] - p
                total[i] += (off * off // p * times[low:high, None]).sum(0)
                more = np.flatnonzero((dense[:, k] > 0) & (p[:, k] > q))
                if len(more):
                    off = p[more, k] - q[more]
                    found[k].append((more + low, off * off // q[more]))
        rows = []
        for k, pieces in found.items():
            index, values = (np.concatenate(x) for x in zip(*pieces))
            best = strongest(values, times[index])
            rows.append((np.full(len(best), k), index[best], values[best]))
        k, index, values = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        a, b = (x.ravel() for x in np.meshgrid(np.array(own), np.arange(size), indexing="ij"))
        other = a != b
        source, none = np.concatenate([a[other], k]), pa.nulls(len(k), pa.string())
        return pa.table(
            {
                "lang": pa.repeat(pa.scalar(lang, pa.string()), len(source)),
                "source": names.take(pa.array(source, pa.int64())),
                "item": pa.concat_arrays([names.take(pa.array(b[other], pa.int64())), none]),
                "value": pa.array(np.concatenate([total.ravel()[other], values]), pa.int64()),
                "vec": pa.concat_arrays([pa.nulls(int(other.sum()), vec.type), vec.take(pa.array(index, pa.int64()))]),
            }
        )

    keys = ["lang", "salt", "block"]
    schema = f"lang string, source string, item string, value long, vec {kind}"
    return stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema), "evaluated")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item string, value long, rank int) of every group: ``pair`` for each other source, ``term`` for its first TOP terms."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    terms = kept_terms(rows)
    vectors = stored(terms.groupBy("lang", "vec").agg(F.count("*").alias("times")), "term-vectors")
    found = evaluated(vectors, group_facts(rows, terms))
    pairs = found.where("vec is null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # of terms with one vector, which have one value, no more than the first TOP can be ranked
    alike = Window.partitionBy("lang", "vec").orderBy("term")
    firsts = terms.withColumn("_place", F.row_number().over(alike)).where(F.col("_place") <= TOP).drop("_place")
    strong = found.where("vec is not null").drop("item").join(firsts, ["lang", "vec"]).select("lang", "source", F.col("term").alias("item"), "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [
        pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank")),
        strong.select("lang", "source", F.lit("term").alias("part"), "item", "value", place.alias("rank")).where(F.col("rank") <= TOP),
    ]
    return ranked[0].unionByName(ranked[1])
