"""Versioned tables and artifacts: data first, then a row in a log that makes it the version to read.

A version is a folder that nothing reads until its row is in the log, and rows are
only added, so a write that fails, or is seen halfway, leaves the version before it
as it was.  The log is a folder of one-row files that Spark reads and writes, so it
lies in any store that Spark knows.  Two writers that take the same number collide on
the log's folder for it, and the later one fails.
"""

from __future__ import annotations

import datetime
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "name string, kind string, version int, path string, at timestamp, note string"


class NoVersion(LookupError):
    """A name of which no version was written."""


class VersionConflict(RuntimeError):
    """Another writer took the same version number."""


class Versions:
    """Named tables under a folder, each with its versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self) -> DataFrame:
        """(name, kind, version, path, at, note) of all versions."""
        try:
            return self.spark.read.schema(LOG).json(f"{self.root}/log/*/*")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LOG)

    def last(self, name: str) -> int:
        """The newest version's number; 0 without one."""
        return self.log().where(F.col("name") == name).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def write(self, df: DataFrame, name: str, kind: str = "table", note: str | None = None, version: int | None = None, partition_by: list[str] | None = None) -> int:
        """Writes the next version (or the one given) and returns its number."""
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"not a name for a folder: {name!r}")
        number = self.last(name) + 1 if version is None else version
        path = f"{self.root}/data/{name}/v{number}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        row = self.spark.createDataFrame([(name, kind, number, path, datetime.datetime.now(), note)], LOG).coalesce(1)
        try:
            row.write.mode("error").json(f"{self.root}/log/{name}/v{number}")
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" in str(e):
                raise VersionConflict(f"{name} v{number}") from e
            raise
        return number

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A version of a table, the newest one without a number."""
        of = self.log().where(F.col("name") == name)
        rows = of.where(F.col("version") == version) if version else of
        found = rows.orderBy(F.desc("version")).first()
        if found is None:
            raise NoVersion(f"{name} v{version}" if version else name)
        return self.spark.read.parquet(found["path"])

    def latest(self, kind: str) -> DataFrame:
        """(name, version, path, at) of the newest version of every name of a kind."""
        newest = F.max_by(F.struct("version", "path", "at"), "version").alias("v")
        return self.log().where(F.col("kind") == kind).groupBy("name").agg(newest).select("name", "v.*")

    def names_in_use(self) -> DataFrame:
        """(key): folders that some version names; all others may be cleared away."""
        return self.log().select(F.col("path").alias("key"))


def approve(
    versions: Versions, session: str, raw: dict[str, DataFrame], specs: dict, links: list[dict], overview: str | None = None
) -> dict[str, int]:
    """Writes every approved table as a new version, then the links, then the session's state; returns the tables' versions.

    Specs and links of files that aren't there are left out.  The links replace those
    before, each sure and confirmed by a person.  The state comes last: a failure before it leaves the session as it was.
    """
    from ..operators.catalog import approved

    tables, sure = approved(raw, {n: s for n, s in specs.items() if n in raw}, [x for x in links if x["tab_a"] in raw and x["tab_b"] in raw])
    done = {name: versions.write(df, f"{session}.{name}", "processed") for name, df in tables.items()}
    spark = versions.spark
    kinds = "tab_a string, col_a string, tab_b string, col_b string, direction string, score double, origin string"
    names = [k.split()[0] for k in kinds.split(", ")]
    versions.write(spark.createDataFrame([tuple(x.get(n) for n in names) for x in sure], kinds), f"{session}.links", "links")
    state = spark.createDataFrame([(session, "ready", "approved", overview)], "session string, status string, discovery string, overview string")
    versions.write(state, f"{session}.state", "state")
    return done
