"""Vector codes: each vector becomes sixteen one-byte indexes into codebooks fitted in whole numbers.

Components become ``floor(256 * x)``, so every distance, sum and mean is exact and
the codes don't depend on how rows are dealt.  The codebooks (16 parts x 64 entries
x width, a size that no number of rows changes) are sent to the tasks.  Arrow
batches take all distances of a part at once as ``|x|^2 - 2 x.c + |c|^2`` with
int64 matrix products, and the first smallest one.  Each task adds up its parts by
entry; the sums meet in one grouped shuffle a round.

Rows whose vector is null or holds a null or non-finite component (as a float: beyond
``LARGEST`` in an array of doubles too) are dropped; an
empty vector is a vector of zeros.  Vectors shorter than the longest one, and a
length that 16 doesn't divide, are filled up with zeros.  With fewer than 64
vectors the codebooks have as many entries.  The first entries come from the
smallest ids: nulls last, repeated ids in the order of their vectors.  Repeated
rows each get a row.  An empty table gives no rows.  Components beyond ``NARROW``
are reckoned in Python's whole numbers; an error beyond a long is null.  Other
columns are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sized, slices, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: int64 products of parts are exact while components are at most so large and parts at most ``WIDE`` long.
NARROW, WIDE = 1 << 26, 128
LARGEST = float(np.finfo(np.float32).max)
#: Sums are added up as two numbers below and above this one, so that a decimal holds either.
LIMB = 10**18
#: Rows of a slice: (rows, entries) distances of one part are held at a time.
SLICE = 4_000


def whole(vectors: pa.Array, width: int) -> np.ndarray:
    """(rows, PARTS * width) whole components, filled up with zeros; Python's integers where int64 is too narrow."""
    ends = vectors.offsets.to_numpy()
    flat = np.floor(vectors.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float64) * SCALE)
    sizes = np.diff(ends)
    small = not len(flat) or np.abs(flat).max() <= NARROW and width <= WIDE
    flat = flat.astype(np.int64) if small else np.array([int(x) for x in flat], object)
    out = np.zeros((len(vectors), PARTS * width), flat.dtype)
    rows = np.repeat(np.arange(len(vectors)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the first nearest entry of a part's codebook."""
    if points.dtype != book.dtype:
        points, book = points.astype(object), book.astype(object)
    far = (points * points).sum(1)[:, None] - 2 * points.dot(book.T) + (book * book).sum(1)[None, :]
    at = far.argmin(1)
    return at, far[np.arange(len(far)), at]


def assigned(rows: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its points, indexes, distances) of each part."""
    width = books.shape[2]
    for k in range(PARTS):
        points = rows[:, k * width : (k + 1) * width]
        yield k, points, *nearest(points, books[k])


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v array<double>) of the rows that are kept."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST))
    return vectors.where(F.col(vector_col).isNotNull() & ~bad).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))


def sums(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, place, n long, high, low decimal): what each entry's parts add up to (high * LIMB + low), over all rows."""
    width, entries = books.shape[2], books.shape[1]
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((PARTS, entries), np.int64)
        total = np.zeros((PARTS, entries, width), object)
        for batch in slices(batches, SLICE):
            for k, points, at, _ in assigned(whole(batch.column(0), width), shared.value):
                n[k] += np.bincount(at, minlength=entries)
                part = np.zeros((entries, width), points.dtype)
                np.add.at(part, at, points)
                total[k] += part.astype(object)
        part, entry = np.nonzero(n)
        if not len(part):
            return
        places = np.tile(np.arange(width), len(part))
        columns = (np.repeat(part, width), np.repeat(entry, width), places, np.repeat(n[part, entry], width))
        found = [divmod(x, LIMB) for x in total[part, entry].ravel()]
        limbs = (pa.array([str(x[i]) for x in found], pa.string()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *limbs], ["part", "entry", "place", "n", "high", "low"])

    out = kept.select("v").mapInArrow(run, "part long, entry long, place long, n long, high string, low string")
    added = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    return out.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), *added)


def codebooks(kept: DataFrame, width: int) -> np.ndarray:
    """(PARTS, entries, width): the codebooks after all rounds."""
    first = kept.orderBy(F.asc_nulls_last("id"), "v").limit(ENTRIES).select("v").toArrow().column(0).combine_chunks()
    rows = whole(first, width)
    books = rows.reshape(len(rows), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        for r in sums(kept, books).collect():  # PARTS x ENTRIES x width rows at most
            mean = (int(r["high"]) * LIMB + int(r["low"])) // r["n"]
            if books.dtype != object and abs(mean) > NARROW:
                books = books.astype(object)
            books[r["part"], r["entry"], r["place"]] = mean
    return books


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((id_col, label_col, code string, error long), codebooks) of all usable vectors; the table is written."""
    kept = stored(usable(vectors, id_col, vector_col, label_col), "vectors")
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // PARTS))
    books = codebooks(kept, width)
    schema = kept.select(F.col("id").alias(id_col), F.col("label").alias(label_col)).schema.add("code", "string").add("error", "long")
    names = [id_col, label_col, "code", "error"]
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            codes = np.zeros((batch.num_rows, PARTS), np.uint8)
            error = np.zeros(batch.num_rows, np.int64)
            for k, _, at, far in assigned(whole(batch.column(2), width), shared.value):
                codes[:, k] = at
                error = error + far  # at most 2**62 unless the parts are Python's integers
            digits = codes.tobytes().hex()
            code = [digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array([e if e < 1 << 63 else None for e in map(int, error)], pa.int64())], names
            )

    return stored(kept.mapInArrow(run, schema), "codes"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, code string, error, label_error long, codebooks_sha256 string) of every usable vector.

    ``label_error`` is the error of all vectors of the row's label (null labels are
    one), summed before the join, so that a label with a third of all rows is one row of it.
    """
    coded, books = encode(vectors, id_col, vector_col, label_col)
    by_label = stored(
        coded.groupBy(F.col(label_col).alias("_lm_label")).agg(F.try_sum("error").alias("label_error")), "label-errors"
    )
    out = coded.join(sized(by_label, by_label.count()), F.col(label_col).eqNullSafe(F.col("_lm_label")), "left")
    return out.select(id_col, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def lookup(code: str, books: np.ndarray) -> list[int]:
    """The whole components that a code stands for."""
    return [int(x) for k in range(PARTS) for x in books[k, int(code[2 * k : 2 * k + 2], 16)]]
