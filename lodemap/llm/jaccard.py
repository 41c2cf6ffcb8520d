"""N-gram Jaccard join with a token-group matrix.

Documents are sets of word n-grams; two link if the Jaccard similarity of their
sets reaches a threshold.  The result is exact: every row with its set's size and
the component that links join it to.

1. Sets.  Rows with equal sets form a class; only one row of each goes on.
2. Groups of similar documents.  A set is dealt by hash into m blocks, so many more
   than two linked sets of that size can differ by that linked sets have at least
   ``need`` equal blocks.  A document that shares fewer is out.  Sets that share a
   block, directly or through others, form a group.  Of large sets, which differ in
   hundreds of tokens, only so many blocks are kept that two linked ones share
   fewer than ``need`` of them with a probability of at most ``LOSS``.
3. Token-group matrix.  For every group the union of its tokens is counted: how many
   members have each.  A query's overlap with the rest of its group bounds its
   overlap with any member: a document below what the threshold asks for is out,
   and where fewer than two remain the group isn't opened at all.
4. Opened groups.  The document with the fewest tokens of its own is the hub of a
   block; each is compared with the hub it shares most blocks with first, which joins
   most of a group by one comparison a member.  Only pairs that share enough blocks
   and lie in different components are compared besides, and of these only such
   whose sketches don't differ by too much: a sketch has the parities of the tokens
   in each of ``BITS`` cells, and each token of only one of two sets flips one bit.

No all-pairs list of a group is made, no group is gathered in a task, and nothing
but counts reaches the driver.  All that is found by block or token is aggregated in
the tasks before it is dealt out.  Where rows must meet the one row of their hub,
label, group or set, keys of many rows are split and that row goes to each part
(``spread``), so that what a third of all rows share is no hot key.  Token hashes have 64 bits; hashes of blocks and matrix rows have 48, whose
rare collisions only add comparisons.  Tables that are no longer needed are deleted.

Null or empty text has the empty set, links with nothing and is a component of its
own.  Repeated rows and ids each give a row.  A component's id is the smallest
non-null id in it.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, numbered, parted, sized, slices, spread, stored

#: Sizes in one class differ at most by this factor (or by 1 / threshold if that is more).
RATIO = 1.5
#: Documents with too many empty blocks are dealt again so many times.
DEALS = 3
#: Of the blocks that two linked sets can differ in, so many more are equal besides.
MORE = 0.1
#: The blocks of large sets: equal ones that are asked for, and how likely two linked sets may have fewer.
SAME, LOSS = 8, 1e-12
CACHE_WORDS = 50_000
#: Bits of a sketch, in longs.
BITS = 1024
#: So many pairs with one document, and more, are split over tasks, each with its text.
PAIRS = 2_000
WORDS = [f"s{i}" for i in range(BITS // 64)]
MASK = np.uint64((1 << 48) - 1)


class WordHashes(dict):
    """Hash of a word as 8 bytes, made on first use."""

    def __missing__(self, word: bytes) -> bytes:
        self[word] = made = xxhash.xxh64_digest(word)
        return made


_words = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of the whole sequence if it has fewer than n words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    h = np.frombuffer(b"".join(map(_words.__getitem__, words)), "<u8").astype(np.uint64)
    n = min(n, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


class Sizes:
    """Size classes of a threshold num / den, and how each deals its sets: in how many blocks, how many
    of these are kept, how many are equal in two linked sets, and how many of these aren't empty in both."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]
        self.blocks: list[int] = []
        self.kept: list[int] = []
        self.equal: list[int] = []
        self.need: list[int] = []

    def extend(self, size: int) -> None:
        ratio = max(RATIO, self.den / self.num)
        while len(self.low) < 3 or self.low[-2] <= size:
            low = self.low[-1]
            high = max(low + 1, math.ceil(low * ratio))
            differ = 2 * (high - 1) * (self.den - self.num) // (self.den + self.num)
            deal = (0, 0, 0, 0)
            if differ:
                deal = self.all_blocks(low, differ)
                if low > differ:
                    deal = min(deal, self.some_blocks(low, differ), key=lambda x: x[1])
            self.low.append(high)
            for values, x in zip((self.blocks, self.kept, self.equal, self.need), deal):
                values.append(x)

    @staticmethod
    def all_blocks(low: int, differ: int) -> tuple[int, int, int, int]:
        """More blocks than two linked sets can differ in: the rest of them are equal."""
        need = equal = 1 + int(MORE * differ)
        for _ in range(8):
            equal = need + math.ceil(1.5 * (differ + equal) * math.exp(-low / (differ + equal)))
            if equal > low:
                need, equal = 1, low
                break
        return differ + equal, differ + equal, equal, need

    @staticmethod
    def some_blocks(low: int, differ: int) -> tuple[int, int, int, int]:
        """As many of ``differ`` blocks as make fewer than ``equal`` equal ones no likelier than LOSS.

        A block is equal if none of the differences is dealt to it.  These events are
        negatively associated, so Chernoff's bound for independent ones holds.
        """
        q = (1 - 1 / differ) ** differ if differ > 1 else 0.0
        kept = 32
        while kept <= differ:
            equal = SAME + math.ceil(1.5 * kept * math.exp(-low / differ))
            z = (equal - 1) / kept
            if z < q and kept * (z * math.log(z / q) + (1 - z) * math.log((1 - z) / (1 - q))) >= -math.log(LOSS):
                return differ, kept, equal, SAME
            kept += 4
        return differ, 1 << 62, 0, 0

    def classes(self, size: int) -> list[int]:
        """The class of a size, and the next one if larger sets there can link with it."""
        self.extend(size)
        c = int(np.searchsorted(self.low, size, "right")) - 1
        return [c, c + 1] if size * self.den >= self.low[c + 1] * self.num else [c]


def block_tokens(sets: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, int]:
    """Size class and 48-bit hash of the kept blocks of a set, in each of its size classes, and how many a linked set shares at least.

    ``equal`` blocks of two linked sets are equal.  If so many of a set's blocks are
    empty that fewer than ``need`` of these might be left, it is dealt anew by
    another hash; the last deal also tells which blocks are empty.
    """
    out, least = [], 1 << 30
    for c in sizes.classes(len(sets)):
        m, kept = sizes.blocks[c], sizes.kept[c]
        if not m:  # only equal sets can link
            continue
        for deal in range(DEALS):
            h = mixed(sets + np.uint64(0x632BE59BD9B4E019 * (deal + 1) % (1 << 64)))
            at = (h >> np.uint64(33)) % np.uint64(m)
            if kept < m:
                h, at = h[at < kept], at[at < kept]
            order = np.argsort(at, kind="stable")
            there, start = np.unique(at[order], return_index=True)
            salt = np.uint64((c * DEALS + deal + 1) * 0xD1342543DE82EF95 % (1 << 64))
            if len(there):
                sums = np.add.reduceat(h[order], start)
                out.append(mixed(sums + mixed(there + salt)) & MASK | np.uint64(c << 48))
            empty = kept - len(there)
            if empty <= sizes.equal[c] - sizes.need[c]:
                least = min(least, sizes.equal[c] - empty if not deal else 1)
                break
            least = 1
            if deal == DEALS - 1:
                gone = np.setdiff1d(np.arange(kept, dtype=np.uint64), there)
                out.append(mixed(mixed(gone + salt)) & MASK | np.uint64(c << 48))
    return (np.unique(np.concatenate(out)), least) if out else (np.empty(0, np.uint64), 1)


def set_key(sets: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from all others."""
    raw = xxhash.xxh3_128_digest(sets.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def sketch(sets: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens in each of BITS cells, as longs."""
    at = (mixed(sets + np.uint64(0x9E6C63D0676A9A99)) >> np.uint64(20)) % np.uint64(BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def size_class(token) -> Column:
    return F.shiftright(token, 48)


def lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def describe(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_shingles, k1, k2, cls, need, tokens): sizes, set keys, size classes and block tokens of all rows."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(num, den)
        for batch in slices(batches):
            found = [shingles(t.as_py(), n) for t in batch.column(2)]
            keys = [set_key(s) for s in found]
            dealt = [block_tokens(s, sizes) if len(s) else (s, 1) for s in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([sizes.classes(len(s))[0] for s in found], pa.int64()),
                    pa.array([d[1] for d in dealt], pa.int64()),
                    lists([d[0] for d in dealt]),
                ],
                ["row", "id", "n_shingles", "k1", "k2", "cls", "need", "tokens"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"row long, id {kind}, n_shingles long, k1 long, k2 long, cls long, need long, tokens array<long>")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): connected components of (a, b) edges, the label being the smallest node in each.

    Smallest neighbour and pointer jumping, so rounds grow with the logarithm of
    the longest path; each round is written, which cuts the lineage.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), name)
    while True:
        near = spread(both, labels.withColumnsRenamed({"node": "b"}), ["b"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = stored(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), name)
        over = step.select(F.col("node").alias("label"), F.col("label").alias("over"))
        new = stored(spread(step, over, ["label"]).select("node", F.least("label", "over").alias("label"), "old"), name)
        changed = new.where("label <> old").count()
        discard(labels, step)
        labels = new.drop("old")
        if not changed:
            discard(both)
            return labels


def in_several(tokens: DataFrame) -> DataFrame:
    """(token, first, n): the tokens that several nodes of (token, node) have, with the smallest of these nodes, and their rows."""
    ends = tokens.groupBy("token").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n"))
    return ends.where("first <> last").select("token", "first", "n")


def blocks_in_several(tokens: DataFrame) -> DataFrame:
    """The same for (token, node, cls), but for those of a size class that only nodes of a smaller one share: these share others."""
    ends = tokens.groupBy("token").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.max("cls").alias("cls"), F.count("*").alias("n"))
    return ends.where((F.col("first") != F.col("last")) & (F.col("cls") == size_class("token"))).select("token", "first", "n")


def grouped_by_blocks(shared: DataFrame) -> DataFrame:
    """(node, label): components of nodes that share tokens, from (token, node, first), ``first`` being a token's smallest node.

    A node first takes the smallest ``first`` of its tokens as its label, which
    joins nearly all of a large group; only where the labels under a token still
    differ is there an edge between labels, so edges don't grow with a group's size.
    """
    early = stored(shared.groupBy("node").agg(F.min("first").alias("early")), "early-labels")
    under = stored(shared.select("token", "node").join(early, "node").select("token", "early").distinct(), "token-labels")
    lowest = stored(in_several(under.withColumnRenamed("early", "node")), "lowest-labels")
    edges = spread(under, lowest.drop("n"), ["token"], counts=lowest.select("token", "n")).where("early <> first").select(F.col("early").alias("a"), F.col("first").alias("b")).distinct()
    labels = components(edges, "groups").withColumnsRenamed({"node": "early"})
    discard(under, lowest)
    return spread(early, labels, ["early"], how="left").select("node", F.coalesce("label", "early").alias("label"))


def overlaps(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, one, two, shared long): sizes and intersections of the sets of (a, b) pairs, by the whole texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, last, seen = [], None, None
            for x, y in zip(batch.column(2), batch.column(3)):
                y = y.as_py()
                if y != last:
                    last, seen = y, shingles(y, n)
                one = shingles(x.as_py(), n)
                sizes.append((len(one), len(seen), len(np.intersect1d(one, seen, assume_unique=True))))
            found = np.array(sizes, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(found[:, k]) for k in range(3))], ["a", "b", "one", "two", "shared"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    dealt, sent, by = parted(pairs, two, ["b"], PAIRS)  # before the rows carry a text
    both = spread(dealt, one, ["a"], PAIRS).join(sent, by).select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long, one long, two long, shared long")


def reaching(found: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of those ``overlaps`` that reach the threshold."""
    return found.where(den * F.col("shared") >= num * (F.col("one") + F.col("two") - F.col("shared"))).select("a", "b")


def bounded(members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Token-group matrix and what passes its bound.

    ``members`` is (node, grp, n_shingles, text).  Returns (node, grp, n_shingles,
    own long) of the nodes whose overlap with the union of the rest of their group
    reaches what the threshold asks of two sets of their size and the group's
    smallest; ``own`` is the number of tokens that no other member has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for node, grp, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                s = shingles(text.as_py(), n)
                cell = mixed(s + mixed(np.array([grp.as_py()], np.uint64))) & MASK
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.view(np.int64)), pa.array(np.full(len(s), node.as_py(), np.int64))], ["cell", "node"]
                )

    cells = members.select("node", "grp", "text").mapInArrow(run, "cell long, node long")
    alone = cells.groupBy("cell").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    own = alone.groupBy("node").agg(F.count("*").alias("own"))
    smallest = members.groupBy("grp").agg(F.min("n_shingles").alias("least"))
    facts = spread(members.select("node", "grp", "n_shingles"), smallest, ["grp"]).join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    size = F.col("n_shingles")
    partner = F.greatest(F.ceil(size * num / den), F.col("least"))
    need = F.ceil((size + partner) * num / (num + den) - 1e-9)
    return facts.where(size - F.col("own") >= need).select("node", "grp", "n_shingles", "own")


def similarity_components(
    docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_shingles long, component_id): components of documents with den * |intersection| >= num * |union|."""
    sets = stored(describe(docs, n, num, den, id_col, text_col), "sets")
    base = stored(sets.drop("tokens"), "set-keys")
    nodes = stored(
        base.where("n_shingles > 0")
        .groupBy("k1", "k2")
        .agg(F.min("row").alias("node"), F.min("id").alias("low"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("need").alias("need"), F.first("cls").alias("cls")),
        "classes",
    )
    again = nodes.where("copies > 1").select("k1", "k2", "node")
    copies = stored(
        spread(base.where("n_shingles > 0").select("row", "k1", "k2"), again, ["k1", "k2"]).where("row <> node").select("row"), "copies"
    )
    singles = sets.join(sized(copies, copies.count()), "row", "left_anti")

    # Blocks that two classes or more share, with the smallest of them; of classes that share enough.
    tokens = singles.select(F.explode("tokens").alias("token"), F.col("row").alias("node"), "cls")
    several = stored(blocks_in_several(tokens), "shared-tokens")
    seen = stored(spread(tokens.drop("cls"), several.select("token"), ["token"], counts=several.select("token", "n")), "listed-blocks")
    discard(sets, copies, several)
    enough = seen.groupBy("node").agg(F.count("*").alias("n")).join(nodes.select("node", "need", "cls"), "node").where("n >= need").drop("n")
    listed = stored(seen.join(enough, "node"), "dense-blocks")
    discard(seen)
    several = stored(blocks_in_several(listed), "shared-tokens")
    shared = stored(spread(listed, several.drop("n"), ["token"], counts=several.select("token", "n")).select("token", "node", "need", "cls", "first"), "shared-blocks")
    discard(listed, several)
    groups = grouped_by_blocks(shared)

    # Texts of the grouped classes: found by id, told apart by set key.
    grouped = stored(groups.join(nodes, "node").select("node", F.col("label").alias("grp"), "k1", "k2", "low", "n_shingles"), "grouped")
    members = stored(keyed_texts(docs, grouped, n, id_col, text_col), "texts")
    live = stored(bounded(members, n, num, den).join(members.select("node", *WORDS), "node"), "open")
    texts = members.select("node", "text")

    found = stored(shared.drop("first").join(live.select("node", "own"), "node"), "open-blocks")
    rank = F.struct("own", "node")
    first = stored(found.groupBy("token").agg(F.min(rank)["node"].alias("hub"), F.count("*").alias("n")).where("n > 1"), "token-hubs")
    hubs = (
        spread(found, first.drop("n"), ["token"], counts=first.select("token", "n"))
        .where("node <> hub")
        .groupBy("node", "hub")
        .agg(F.count("*").alias("n"))
        .groupBy("node")
        .agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"))
        .select(F.col("node").alias("a"), F.col("hub").alias("b"))
    )
    hubs = stored(hubs, "hub-pairs")
    links = stored(reaching(overlaps(hubs, texts, n), num, den), "hub-links")
    labels = stored(
        live.select("node").join(components(links, "hub-components"), "node", "left").select("node", F.coalesce("label", "node").alias("label")),
        "hub-labels",
    )

    # What is left: pairs that share enough blocks, in different components, whose sets may differ by little enough.
    parts = stored(found.join(labels, "node"), "parts")
    labelled = parts.groupBy("token").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count("*").alias("n"))
    labelled = stored(labelled.where("l1 <> l2").select("token", "n"), "mixed-tokens")
    parts = spread(parts, labelled.select("token"), ["token"], counts=labelled).select("token", "node", "need", "cls", "label").join(live, "node")
    one, two = parts.alias("p"), parts.alias("q")
    both = (F.col("p.n_shingles") + F.col("q.n_shingles")) * (den - num)
    room = (F.col("p.own") + F.col("q.own")) * (num + den) <= both
    close = (F.col("p.n_shingles") * den >= F.col("q.n_shingles") * num) & (F.col("q.n_shingles") * den >= F.col("p.n_shingles") * num)
    alike = sum(F.bit_count(F.col(f"p.{w}").bitwiseXOR(F.col(f"q.{w}"))) for w in WORDS) * (num + den) <= both
    place = (F.col("p.token") == F.col("q.token")) & (size_class("p.token") == F.greatest("p.cls", "q.cls"))
    rest = (
        one.join(two, place & (F.col("p.node") < F.col("q.node")) & (F.col("p.label") != F.col("q.label")) & room & close & alike)
        .groupBy(F.col("p.node").alias("a"), F.col("q.node").alias("b"))
        .agg(F.count("*").alias("n"), F.first(F.greatest("p.need", "q.need")).alias("need"))
        .where("n >= need")
        .select("a", "b")
    )
    tested = hubs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(rest.join(tested, ["a", "b"], "left_anti"), "rest-pairs")
    more = stored(reaching(overlaps(rest, texts, n), num, den), "rest-links")
    ends = more.join(labels.withColumnsRenamed({"node": "a", "label": "la"}), "a").join(labels.withColumnsRenamed({"node": "b", "label": "lb"}), "b")
    merged = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "components")
    final = spread(labels, merged.select(F.col("node").alias("label"), F.col("label").alias("over")), ["label"], how="left").select("node", F.coalesce("over", "label").alias("label"))

    # Back to all rows.
    classes = stored(nodes.join(final, "node", "left").select("k1", "k2", "low", F.coalesce("label", "node").alias("label")), "class-labels")
    lowest = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    classes = stored(spread(classes, lowest, ["label"]).select("k1", "k2", "component_id"), "class-components")
    discard(shared, grouped, members, live, found, hubs, parts)
    full = spread(base.where("n_shingles > 0").select("row", "id", "n_shingles", "k1", "k2"), classes, ["k1", "k2"]).select("id", "n_shingles", "component_id")
    empty = base.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return full.unionByName(empty).withColumnRenamed("id", id_col)


def keyed_texts(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(node, grp, n_shingles, text, WORDS...): one text, and its sketch, for each of the ``wanted`` classes (node, grp, k1, k2, low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t.as_py(), n) for t in batch.column(0)]
            keys = np.array([set_key(s) for s in sets], np.int64).reshape(-1, 2)
            words = np.array([sketch(s) for s in sets], np.int64).reshape(-1, len(WORDS))
            columns = [pa.array(keys[:, 0]), pa.array(keys[:, 1]), batch.column(0), *(pa.array(w) for w in words.T)]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "text", *WORDS])

    ids = wanted.select(F.col("low").alias("_low")).distinct()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.join(sized(ids, ids.count()), F.col("_id").eqNullSafe(F.col("_low")), "left_semi").select("_text")
    found = rows.mapInArrow(run, "k1 long, k2 long, text string, " + ", ".join(f"{w} long" for w in WORDS))
    return found.join(wanted.select("k1", "k2", "node", "grp", "n_shingles"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("node", "grp", "n_shingles", "text", *WORDS)


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest non-null id (of equal rows one); all columns stay."""
    rows = numbered(docs)
    texts = rows.select("row", F.col("doc")[text_col].alias("text"))
    found = stored(similarity_components(texts, n, num, den, "row", "text").select("row", "component_id"), "row-components")
    several = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(spread(found, several.select("component_id"), ["component_id"]), "repeats")
    ids = rows.select("row", F.col("doc")[id_col].alias("id")).join(sized(shared, shared.count()), "row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("row"))
    gone = stored(shared.select("row").join(first, "row", "left_anti"), "gone")
    discard(shared, found)
    return rows.join(sized(gone, gone.count()), "row", "left_anti").select("doc.*")
