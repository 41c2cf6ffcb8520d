"""Jobs as a stream of files: a batch's number is its claim, and the state of all jobs is a table with versions.

``step`` takes new jobs and claims what is due: queued ones, and running ones whose
lock has passed.  The claim is written before the work, its outcome after it, both as
versions that are numbered by the batch, so a batch that runs again writes nothing
that it has already written and changes nothing.  Jobs are rows, claims and outcomes
are joins: no job goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder, written
from ..sources.versions import NoVersion, Versions
from .rollup import source_of

#: Seconds of a lock. A job that failed so often stays failed.
LOCK_SECONDS, ATTEMPTS = 1_800, 3
STATE = "job_id string, kind string, payload string, created_at timestamp, status string, attempts int, claim long, locked_until timestamp, message string"
NEW = ["job_id", "kind", "payload", "created_at"]

Work = Callable[[DataFrame], DataFrame]


def state_of(versions: Versions, number: int | None = None) -> DataFrame:
    try:
        return versions.read("jobs", number)
    except NoVersion:
        return versions.spark.createDataFrame([], STATE)


def claimed(state: DataFrame, new: DataFrame, claim: int, now, lock_seconds: int = LOCK_SECONDS) -> DataFrame:
    """The state with new jobs added (known ids are no new jobs) and all that is due claimed."""
    first = new.where("job_id is not null").groupBy("job_id").agg(F.min_by(F.struct(*NEW[1:]), F.struct("created_at", "kind", "payload")).alias("j")).select("job_id", "j.*")
    fresh = first.join(state.select("job_id"), "job_id", "left_anti").select(
        *NEW, F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("long").alias("claim"), F.lit(None).cast("timestamp").alias("locked_until"), F.lit(None).cast("string").alias("message")
    )
    at = F.lit(now).cast("timestamp")
    due = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("locked_until") < at))
    both = state.unionByName(fresh)
    return both.select(
        *NEW,
        F.when(due, "running").otherwise(F.col("status")).alias("status"),
        (F.col("attempts") + F.when(due, 1).otherwise(0)).alias("attempts"),
        F.when(due, F.lit(claim).cast("long")).otherwise(F.col("claim")).alias("claim"),
        F.when(due, at + F.expr(f"interval {lock_seconds} seconds")).otherwise(F.col("locked_until")).alias("locked_until"),
        "message",
    )


def settled(state: DataFrame, outcome: DataFrame, claim: int, attempts: int = ATTEMPTS) -> DataFrame:
    """The state after the work of a claim: done, queued again, or failed for good. A job without an outcome keeps its lock."""
    told = outcome.groupBy(F.col("job_id").alias("_id")).agg(F.min("ok").alias("_ok"), F.max("message").alias("_said"))
    held = state.join(told, F.col("job_id") == F.col("_id"), "left")
    mine = (F.col("status") == "running") & (F.col("claim") == claim) & F.col("_ok").isNotNull()
    after = F.when(F.col("_ok"), "succeeded").when(F.col("attempts") >= attempts, "failed").otherwise("queued")
    return held.select(
        *NEW,
        F.when(mine, after).otherwise(F.col("status")).alias("status"),
        "attempts",
        "claim",
        F.when(~mine, F.col("locked_until")).alias("locked_until"),
        F.when(mine, F.col("_said")).otherwise(F.col("message")).alias("message"),
    )


def step(versions: Versions, new: DataFrame, claim: int, work: Work, now, lock_seconds: int = LOCK_SECONDS, attempts: int = ATTEMPTS) -> None:
    """One claim: versions 2 * claim + 1 (claimed) and 2 * claim + 2 (settled) of the state. ``work`` gives (job_id, ok, message)."""
    have = versions.last("jobs")
    if have < 2 * claim + 1:
        versions.write(claimed(state_of(versions), new.select(*NEW), claim, now, lock_seconds), "jobs", "jobs", version=2 * claim + 1)
        have = 2 * claim + 1
    if have < 2 * claim + 2:
        state = state_of(versions, 2 * claim + 1)
        outcome = written(work(state.where((F.col("claim") == claim) & (F.col("status") == "running")).select(*NEW, "attempts")).select("job_id", "ok", "message"), "outcome")
        versions.write(settled(state, outcome, claim, attempts), "jobs", "jobs", version=2 * claim + 2)


def run_jobs(spark: SparkSession, inbox: str, root: str, work: Work, now=None, lock_seconds: int = LOCK_SECONDS, attempts: int = ATTEMPTS) -> Versions:
    """Takes the new files of ``inbox`` once, a claim for each batch, then claims again while jobs are queued. Returns the state's versions."""
    versions = Versions(spark, f"{root}/state")
    moment = lambda: now or spark.sql("select current_timestamp()").first()[0]
    kind = spark.read.parquet(inbox).schema

    def claim_batch(batch: DataFrame, number: int) -> None:
        # claims of retries lie between those of batches, so a batch's own claim is looked up by its number
        batches = Versions(spark, f"{root}/batches")
        if batches.last(f"b{number}"):
            claim = batches.read(f"b{number}").first()[0]
        else:
            claim = (versions.last("jobs") + 1) // 2
            batches.write(spark.createDataFrame([(claim,)], "claim int"), f"b{number}", "claim")
        step(versions, batch, claim, work, moment(), lock_seconds, attempts)

    stream = spark.readStream.schema(kind).parquet(source_of(spark, inbox))
    stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(claim_batch).start().awaitTermination()
    none = spark.createDataFrame([], STATE)
    for _ in range(attempts):
        if state_of(versions).where("status = 'queued'").isEmpty():
            break
        step(versions, none, (versions.last("jobs") + 1) // 2, work, moment(), lock_seconds, attempts)
    return versions


def events_as_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a job; work on errors fails, and on sign-ups at the first attempt: the state after all of it."""
    root = new_folder(spark, "jobs")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    jobs = e.select(F.col("event_id").cast("string").alias("job_id"), F.col("event_type").alias("kind"), F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("created_at"))
    jobs.write.parquet(f"{root}/inbox")

    def work(due: DataFrame) -> DataFrame:
        ok = (F.col("kind") != "error") & ((F.col("kind") != "signup") | (F.col("attempts") > 1))
        return due.select("job_id", ok.alias("ok"), F.when(~ok, F.concat(F.lit("no "), F.col("kind"))).alias("message"))

    return state_of(run_jobs(spark, f"{root}/inbox", root, work)).select("job_id", "kind", "status", "attempts", "message")
