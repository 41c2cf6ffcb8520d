"""Files to raw tables: dialect sniffing, positional columns, content hashes, texts, versioned sinks."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .charsets import RANGES, detected
from .shared import new_folder

SUFFIXES = (".csv", ".tsv", ".txt", ".md")
SNIFFED = 64 * 1024
#: What the CSV reader makes of the bytes beyond ASCII when it reads them as ISO-8859-1.
UPPER = "".join(map(chr, range(0x80, 0x100)))


class UnsupportedFile(ValueError):
    """A file that none of the readers takes."""


class EmptyFile(ValueError):
    """A file without any row."""


def sniff(sample: str, path: str = "") -> tuple[str, str]:
    """(delimiter, quote) of a sample: the sign that most lines hold; a tab for .tsv and else a comma where none is there."""
    lines = [line for line in sample.split("\n") if line.strip()]
    held = {mark: sum(mark in line for line in lines) for mark in ",;\t|"}
    best = max(held, key=held.get)
    mark = best if held[best] else "\t" if path.lower().endswith(".tsv") else ","
    return mark, "'" if sample.count("'" + mark) > sample.count('"' + mark) else '"'


def encoding_of(spark: SparkSession, path: str) -> tuple[str, float]:
    """(encoding, confidence) of text files, by their mark or by how likely each reading of all their lines is."""
    found, sure = detected(spark, path)
    return {"utf-8": "UTF-8", "utf-16": "UTF-16", "utf-32": "UTF-32"}.get(found, found), sure


def one_byte_signs(encoding: str) -> str | None:
    """The 128 signs of an encoding of one byte beyond ASCII; None if it has several or is ISO-8859-1. Bytes without a sign stay as they are."""
    if codecs.lookup(encoding).name in ("utf-8", "iso8859-1", "ascii"):
        return None
    signs = [bytes([ord(c)]).decode(encoding, "ignore") for c in UPPER]
    if sum(len(s) != 1 for s in signs) > 16 or encoding.lower() in RANGES:
        return None
    return "".join(s or c for s, c in zip(signs, UPPER))


def recoded(spark: SparkSession, path: str, encoding: str) -> str:
    """A copy of text files in UTF-8, in the shared folder: a file a task."""

    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode(encoding, "replace"))

    out = new_folder(spark, "recoded")
    spark.read.format("binaryFile").load(path).select(decode("content").alias("value")).write.text(out)
    return out


def read_raw(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(_row_id, c0..cN string): all rows of delimited files, title and header rows too; ragged rows are filled with null.

    The encoding is found unless it is given. The dialect comes from the files' start,
    the number of columns from one pass over the rows that sees what is quoted. Cells
    may hold line ends if they are quoted; only a table with such cells, or in an encoding
    of several bytes other than UTF-8, is read a file a task, all others are split.
    """
    if not path.lower().rstrip("/").endswith((".csv", ".tsv", ".txt")):
        raise UnsupportedFile(path)
    name = path
    encoding = encoding or encoding_of(spark, path)[0]
    wide = encoding.upper().startswith(("UTF-16", "UTF-32"))
    signs = None if wide else one_byte_signs(encoding)
    if not wide and signs is None and encoding.upper() not in ("UTF-8", "UTF8", "ISO-8859-1", "US-ASCII"):
        path, encoding = recoded(spark, path, encoding), "UTF-8"
    whole = spark.read.text(path, wholetext=True).select(F.decode(F.col("value").cast("binary"), encoding).alias("value")) if wide else None
    lines_of = whole.select(F.explode(F.split("value", r"\r?\n|\r")).alias("value")) if wide else spark.read.text(path)
    lines = [r[0] for r in lines_of.limit(200).collect() if r[0].strip("\ufeff \t\r\n")]  # for the dialect
    if not lines:
        raise EmptyFile(path)
    mark, quote = sniff("\n".join(lines)[:SNIFFED], name)
    quoted = rf"(^|[\{mark}\n\r]) *{quote}(?:[^{quote}]++|{quote}{quote})*+{quote}"

    def width_of(text):
        return F.length(F.regexp_replace(F.regexp_replace(text, quoted, "$1"), rf"[^\{mark}]", "")) + 1

    odd = F.length(F.regexp_replace("value", f"[^{quote}]", "")) % 2 == 1
    width, split = lines_of.agg(F.max(width_of(F.col("value"))), F.max(odd)).first()
    if split:  # a quoted cell may go on in the next line, and its row's columns with it
        texts = whole if wide else spark.read.text(path, wholetext=True)
        rest = texts.select(F.explode(F.split(F.regexp_replace("value", quoted, "$1"), r"\r?\n|\r")).alias("value"))
        width = max(width, rest.agg(F.max(width_of(F.col("value")))).first()[0])
    options = {"sep": mark, "quote": quote, "escape": quote, "header": False, "multiLine": bool(split or wide), "encoding": "ISO-8859-1" if signs else encoding}
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(width)])
    rows = spark.read.options(**options).schema(schema).csv(path)
    cells = [F.translate(c, UPPER, signs).alias(c) if signs else F.col(c) for c in rows.columns]
    return rows.select(F.monotonically_increasing_id().alias("_row_id"), *cells)


def hashed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """One file of each content that isn't known yet."""
    return found.join(known.select("sha256").distinct(), "sha256", "left_anti").groupBy("sha256").agg(F.min("path").alias("path"), F.max("length").alias("length"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, confidence, reason) of text and markdown files, one page each."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    empty = ~F.col("text").rlike(r"\S")
    return rows.select("path", "text", F.when(empty, 0.2).otherwise(0.98).alias("confidence"), F.when(empty, "empty_document").alias("reason"))


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Writes an approved table under its schema version and returns the path."""
    path = f"{root.rstrip('/')}/processed-v{version}"
    df.write.mode("overwrite").parquet(path)
    return path


def unreferenced(stored_keys: DataFrame, *live: DataFrame) -> DataFrame:
    """(key): stored objects that no live table names."""
    names = live[0].select("key")
    for df in live[1:]:
        names = names.unionByName(df.select("key"))
    return stored_keys.select("key").join(names.distinct(), "key", "left_anti")


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """Delimited files as office programs read them: UTF-8 with its mark, a header, CRLF line ends, quotes where a cell needs them.

    Each file has the header; ``files`` says how many there are, else as many as the table has partitions.
    """
    needs = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    cells = [needs(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns]
    head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\n\r') else c for c in df.columns)

    def with_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(["\ufeff" + head + "\r"], pa.string())], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    lines = df.select(F.concat(F.concat_ws(",", *cells), F.lit("\r")).alias("value"))
    (lines.repartition(files) if files else lines).mapInArrow(with_head, "value string").write.mode("overwrite").text(path)
