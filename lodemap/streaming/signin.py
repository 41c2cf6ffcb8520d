"""Sign-in events at least a gap apart, as a stream: state by user, dropped once the watermark has passed the gap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.usage import GAP_MINUTES
from ..sources.shared import new_folder
from .rollup import LATE, source_of

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Spaced(StatefulProcessor):
    """Keeps a user's event if the last kept one is at least ``minutes`` older.

    The state is one moment a user.  A timer of event time removes it when the
    watermark is past the gap: whatever comes then would be kept anyway.
    """

    def __init__(self, minutes: int):
        self.gap = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # (microseconds, id) only: what a user sends in one batch, in order
        batch = pd.concat([r[["at", "i"]] for r in rows]).sort_values(["at", "i"], kind="stable")
        last = int(self.last.get()[0]) if self.last.exists() else None
        kept = []
        for at, i in zip(batch["at"].tolist(), batch["i"].tolist()):
            if last is None or at - last >= self.gap:
                last = at
                kept.append(i)
        if kept:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((last,))
            self.handle.registerTimer((last + self.gap) // 1000 + 1)
        yield pd.DataFrame({"user": [key[0]] * len(kept), "i": kept})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"user": [], "i": []})

    def close(self) -> None:
        pass


def spaced_stream(events: DataFrame, user: str = "user_id", moment: str = "ts", ident: str = "event_id", minutes: int = GAP_MINUTES, late: str = LATE) -> DataFrame:
    """(user, ident) of a stream's kept events, in the order in which batches bring them; null users and moments are left out."""
    kinds = dict(events.dtypes)
    timed = events.where(F.col(user).isNotNull() & F.col(moment).isNotNull()).select(F.col(user).alias("user"), F.col(moment).cast("timestamp").alias("t"), F.col(ident).alias("i"))
    timed = timed.withWatermark("t", late).withColumn("at", F.unix_micros("t"))
    out = timed.groupBy("user").transformWithStateInPandas(Spaced(minutes), f"user {kinds[user]}, i {kinds[ident]}", "Append", "EventTime")
    return out.select(F.col("user").alias(user), F.col("i").alias(ident))


def run_spaced(spark: SparkSession, source: str, out: str, most_files: int | None = None) -> None:
    """Goes once through the files of ``source`` and adds the kept events of what is new since the last run to ``out``.

    Offsets and state lie in ``out``/checkpoint.  A batch that runs again replaces its own rows.
    """
    kind = spark.read.parquet(source).schema
    reader = spark.readStream.schema(kind)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = (
            spaced_stream(reader.parquet(source_of(spark, source)))
            .writeStream.outputMode("append")
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/kept/batch={number}"))
            .start()
        )
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    query.awaitTermination()


def spaced_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept events of the events table, as a stream over its files."""
    out = new_folder(spark, "signin")
    run_spaced(spark, f"{sf_dir}/events.parquet", out)
    return spark.read.parquet(f"{out}/kept/*")
