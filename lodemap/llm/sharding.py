"""Sharding by extendible hashing.

Rows hash to a string of bits.  A directory of bit prefixes says which shard a
row belongs to; a bucket over the byte limit, and only that, splits on one more
bit until every shard fits.  The directory is made from byte totals of prefixes,
so a row's text is read once for its size and is never shuffled.

A key that repeats has one hash and no bit can part its rows.  So the bits of the
key are followed by bits of a row number: a key that holds a third of all rows
splits like any other bucket.  A row larger than the limit is a shard of its own.
Null keys hash like a value of their own; null text has 0 bytes.  An empty table
has no shards.  Columns other than the key and the text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import sized, stored

#: Bits of the key's hash, and of the row number behind it.
KEY_BITS, ROW_BITS = 60, 60
#: A round looks so many bits beyond the prefixes that are still too large.
STEP_BITS = 12


def hash_bits(value: Column) -> Column:
    """60 bits, as text of 0 and 1, of a value's MD5."""
    number = F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("\x00null"))), 1, 15), 16, 10).cast("long")
    return F.lpad(F.bin(number), KEY_BITS, "0")


def directory(sizes: DataFrame, limit_bytes: int) -> DataFrame:
    """(shard string, depth int, shard_rows, shard_bytes) from rows with ``bits`` and ``n_bytes``.

    Each round totals the prefixes of the next STEP_BITS bits of what is still too
    large.  The first round goes just deep enough for the table's total, so its
    groups number a small multiple of the shards.
    """
    sizes = sizes.select("bits", "n_bytes")
    total = sizes.agg(F.sum("n_bytes")).first()[0]
    if total is None:
        return sizes.sparkSession.createDataFrame([], "shard string, depth int, shard_rows long, shard_bytes long")
    bits, done, base = KEY_BITS + ROW_BITS, None, 0
    to = min(bits, 4 + math.ceil(math.log2(max(1, total / limit_bytes))))
    while True:
        cells = sizes.groupBy(F.substring("bits", 1, to).alias("cell")).agg(F.count("*").alias("rows"), F.sum("n_bytes").alias("bytes"))
        depths = F.sequence(F.lit(base), F.lit(to))
        levels = (
            cells.select(F.explode(depths).alias("depth"), "cell", "rows", "bytes")
            .groupBy(F.substring("cell", F.lit(1), F.col("depth")).alias("shard"), "depth")
            .agg(F.sum("rows").alias("shard_rows"), F.sum("bytes").alias("shard_bytes"))
        )
        levels = stored(levels, "shard-levels")
        fits = (F.col("shard_bytes") <= limit_bytes) | (F.col("shard_rows") == 1) | (F.col("depth") == bits)
        # A bucket stays whole if it fits and its parent, one bit shorter, does not.
        split = levels.where(~fits).select(F.col("shard").alias("parent"))
        leaves = levels.where(fits & (F.col("depth") > 0)).withColumn("parent", F.expr("left(shard, depth - 1)")).join(split, "parent", "left_semi").drop("parent")
        if base == 0:
            leaves = leaves.unionByName(levels.where(fits & (F.col("depth") == 0)))
        leaves = leaves.select("shard", "depth", "shard_rows", "shard_bytes")
        done = leaves if done is None else done.unionByName(leaves)
        large = levels.where(~fits & (F.col("depth") == to)).select(F.col("shard").alias("_large"))
        n = large.count()
        if n == 0:
            return stored(done, "shard-directory")
        prefix = F.substring("bits", 1, to).alias("_large")
        sizes = sizes.withColumn("_large", prefix).join(sized(large, n), "_large", "left_semi").drop("_large")
        base, to = to, min(bits, to + STEP_BITS)


def shard(docs: DataFrame, limit_bytes: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A shard for every row: (key_col, n_bytes long, shard string, depth int, shard_rows long, shard_bytes long).

    ``shard`` is the hash prefix of the row's bucket ('' while one bucket holds all).
    """
    rows = stored(sized_rows(docs, F.col(key_col).alias("_key"), F.col(key_col), F.col(text_col)), "shard-rows")
    return placed(rows, directory(rows, limit_bytes)).withColumnRenamed("_key", key_col)


def sized_rows(docs: DataFrame, kept: Column, key: Column, text: Column) -> DataFrame:
    """(kept, n_bytes long, bits string): the size of each row and the bits that place it."""
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return docs.select(kept, n_bytes.alias("n_bytes"), F.concat(hash_bits(key), hash_bits(F.monotonically_increasing_id())).alias("bits"))


def placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows without their bits, with (shard, depth, shard_rows, shard_bytes) of their bucket in a directory."""
    depths = [r[0] for r in found.select("depth").distinct().collect()]  # 121 at most
    n = found.count()
    # A row's bucket is the one prefix of its bits that the directory has.
    prefixes = F.array(*[F.expr(f"left(bits, {d})") for d in sorted(depths)]) if depths else F.array(F.lit(""))
    return (
        rows.withColumn("shard", F.explode(prefixes))
        .join(sized(found, n), "shard")
        .select(*[c for c in rows.columns if c != "bits"], "shard", "depth", "shard_rows", "shard_bytes")
    )


def write_shards(docs: DataFrame, path: str, limit_bytes: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes whole rows, also of null and repeated keys, each shard in a folder ``_shard=s<bits>``, and returns the directory.

    A row carries its own bits to its shard, so nothing is joined by key.  A column
    ``_shard`` of ``docs`` would be lost: it is refused.
    """
    if "_shard" in docs.columns:
        raise ValueError("a column is called _shard, as the folders are")
    whole = stored(sized_rows(docs, F.struct("*").alias("doc"), F.col(key_col), F.col(text_col)), "shard-rows")
    found = directory(whole, limit_bytes)
    rows = placed(whole, found).select("doc.*", F.concat(F.lit("s"), "shard").alias("_shard"))
    rows.repartition("_shard").write.partitionBy("_shard").parquet(path)
    return found
