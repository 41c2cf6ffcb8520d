"""Shared folder, table loading and small column helpers of the operators.

Intermediate tables are written as Parquet to the folder that the cluster names
in ``spark.checkpoint.dir``: every executor sees them, they cut the lineage, and
a lost executor costs only the tasks that had not been written yet.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000
#: Keys of fewer rows than HOT_ROWS are never split; fewer than HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 50_000, 10_000
#: Labels are narrow: so many rows may be broadcast.
LABELS_BROADCAST = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; on a local master without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lodemap-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/lodemap/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder in any store that Arrow knows."""
    if uri.startswith("file:") or uri.startswith("/"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def discard(*tables: DataFrame) -> None:
    """Deletes ``stored`` tables that no later step reads; what was made of them must have been written.

    Only whole tables of this library's own folder go.  A store that Arrow doesn't know keeps them.
    """
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if "/lodemap/" in folder:
                with contextlib.suppress(OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
                    fs, path = file_system(folder)
                    fs.delete_dir(path)


def numbered(docs: DataFrame) -> DataFrame:
    """(doc struct, row long), written: whole rows, whatever their columns are called, and a number for each."""
    return stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is (a shuffle join)."""
    return F.broadcast(df) if rows <= limit else df


def trusted(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose label says that their quality is good."""
    good = labels.where("quality = 1").select(F.col(id_col).alias("_lm_id")).distinct()
    return docs.join(sized(good, good.count(), LABELS_BROADCAST), F.col(id_col) == F.col("_lm_id"), "left_semi")


def parted(
    rows: DataFrame, keyed: DataFrame, on: list[str], most: int | None = None, counts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join of ``rows`` with ``keyed``, which has one row a key, and the columns to join on.

    A key of more than ``most`` rows (HOT_ROWS if None), and of more than one in HOT_KEYS of all, is dealt
    out in parts by the hash of its other columns, and its row of ``keyed`` goes to each
    part; so no task gets all rows of a key. There are fewer than HOT_KEYS such keys,
    whatever the input, and only they are broadcast. Null keys join with nothing.
    ``counts`` is a written table (key, n) of all keys that occur in ``keyed``; without
    it ``rows`` are counted, so they should be a written table.
    """
    most = HOT_ROWS if most is None else most
    n = rows.count() if counts is None else counts.agg(F.sum("n")).first()[0] or 0
    if n <= most:
        return rows, keyed, on
    part = "_part_" + on[0]
    if counts is None:
        counts = rows.groupBy(*on).agg(F.count("*").alias("n"))
    hot = counts.select(*on, F.ceil(F.col("n") / max(most, n // HOT_KEYS)).cast("int").alias("_parts")).where("_parts > 1")
    hot, parts = F.broadcast(hot), F.coalesce("_parts", F.lit(1))
    others = [c for c in rows.columns if c not in on]
    dealt = rows.join(hot, on, "left").withColumn(part, F.pmod(F.xxhash64(*others), parts).cast("int"))
    sent = keyed.join(hot, on, "left").withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("_parts"), sent.drop("_parts"), [*on, part]


def spread(
    rows: DataFrame, keyed: DataFrame, on: list[str], most: int | None = None, counts: DataFrame | None = None, how: str = "inner"
) -> DataFrame:
    """The join (inner or left) of what ``parted`` makes of two tables."""
    dealt, sent, by = parted(rows, keyed, on, most, counts)
    return dealt.join(sent, by, how).drop(*set(by) - set(on))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of so many rows, so that what a worker makes of one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        pa.default_memory_pool().release_unused()


def ascii_lower(word: Column) -> Column:
    """Lower-cases A-Z only. Words without capitals and ASCII words take the fast built-in."""
    low = F.lower(word)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when((low == word) | (F.octet_length(word) == F.char_length(word)), low).otherwise(
        F.translate(word, capitals, capitals.lower())
    )
