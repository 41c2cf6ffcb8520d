"""Daily rollups of an event stream, with late events up to a day, and the same once through for files that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder

LATE = "1 day"


def daily_stream(events: DataFrame, late: str = LATE) -> DataFrame:
    """(day, event_type, n, total) of a stream of events; a day is final once the watermark has passed it."""
    timed = events.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    days = timed.groupBy(F.window("_at", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return days.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def distinct_stream(events: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """Events without those whose key was seen inside the watermark."""
    return events.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")


def daily_rollup_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of the events table as a stream over its files.

    Each batch writes its changed days under its number, so a batch that is run
    again after a failure overwrites itself; the last state of a day is the rollup.
    """
    source = f"{sf_dir}/events.parquet"
    kind = spark.read.parquet(source).schema
    out = new_folder(spark, "daily")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/state/batch={number}")

    stream = spark.readStream.schema(kind).parquet(source_of(spark, source))
    query = daily_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    states = spark.read.parquet(f"{out}/state/*")
    last = states.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return last.select(F.to_date("start").alias("day"), "event_type", F.col("s.n").alias("n"), F.round("s.total", 2).alias("total"))


def source_of(spark: SparkSession, path: str) -> str:
    """What a file stream reads for a table: its folder, or a pattern that only the table's one file matches."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    alone = any(f.rstrip("/").rsplit("/", 1)[-1] == name for f in spark.read.parquet(path).inputFiles())
    return path.replace(name, f"[{name[0]}]{name[1:]}") if alone else path
