"""Streams: the sign-in gap with state, restarts, late and repeated events, progress."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from lodemap.operators import usage
from lodemap.streaming import progress, rollup, signin
from tests.conftest import TINY

START = datetime.datetime(2024, 1, 1)


def write(spark, path, rows):
    df = spark.createDataFrame([(i, START + datetime.timedelta(minutes=m), u) for i, m, u in rows], "event_id long, ts timestamp_ntz, user_id long")
    df.coalesce(1).write.mode("append").parquet(path)


def kept(spark, out):
    return sorted(r["event_id"] for r in spark.read.parquet(f"{out}/kept/*").collect())


def test_gap_goes_on_after_a_restart(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    write(spark, source, [(1, 0, 7), (2, 9, 7), (3, 12, 7), (4, 3, 8), (5, 4, None)])
    signin.run_spaced(spark, source, out)
    assert kept(spark, out) == [1, 3, 4]
    write(spark, source, [(6, 14, 7), (7, 22, 7), (8, 13, 8), (9, 12, 8)])  # 12 and 13 of user 8: in order of time
    signin.run_spaced(spark, source, out)
    assert kept(spark, out) == [1, 3, 4, 7, 8]
    signin.run_spaced(spark, source, out)  # nothing new
    assert kept(spark, out) == [1, 3, 4, 7, 8]


def test_old_state_is_dropped_and_late_events_are_left_out(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for rows in ([(1, 0, 7)], [(2, 5000, 9)], [(3, 5001, 7), (4, 5002, 7)], [(5, 1, 7)]):
        write(spark, source, rows)
        signin.run_spaced(spark, source, out)
    assert kept(spark, out) == [1, 2, 3]  # the last one is older than the watermark


def test_stream_equals_the_batch_in_several_files(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    events = spark.read.parquet(f"{TINY}/events.parquet").select("event_id", "ts", "user_id")
    edges = [r[0] for r in events.orderBy("ts").select("ts").collect()][::400]
    for low, high in zip(edges, [*edges[1:], None]):  # a file after the other, each in a run of its own
        part = events.where(F.col("ts") >= F.lit(low)) if high is None else events.where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high)))
        part.coalesce(1).write.mode("append").parquet(source)
        signin.run_spaced(spark, source, out, most_files=1)
    assert kept(spark, out) == sorted(r["event_id"] for r in usage.spaced(events).collect())


def test_repeated_events_come_once(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    write(spark, source, [(1, 0, 7), (1, 0, 7), (2, 1, 7)])
    write(spark, source, [(2, 1, 7), (3, 2, 7)])
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long").parquet(source)
    query = rollup.distinct_stream(stream, "event_id").writeStream.format("parquet").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start(f"{out}/d")
    query.awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{out}/d").collect()) == [1, 2, 3]


def test_progress_rows_equal_the_batches(spark, tmp_path):
    log = progress.ProgressLog(spark, f"file://{tmp_path}/log")
    spark.streams.addListener(log)
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    try:
        write(spark, source, [(1, 0, 7), (2, 30, 7)])
        write(spark, source, [(3, 60, 7)])
        signin.run_spaced(spark, source, out, most_files=1)
        broken = spark.readStream.schema("event_id long").parquet(source).writeStream.option("checkpointLocation", f"{out}/x").trigger(availableNow=True)

        def fail(batch, number):
            raise RuntimeError("broken on purpose")

        with pytest.raises(Exception, match="broken on purpose"):
            broken.foreachBatch(fail).start().awaitTermination()
        for _ in range(100):  # listeners are told a little later
            if len(log.ended) == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    rows = log.read().collect()
    good = [r for r in rows if r["query"] == next(r["query"] for r in rows if r["kind"] == "done")]
    batches = [r for r in good if r["kind"] == "batch"]
    assert sum(r["rows"] for r in batches) == 3 and [r["batch"] for r in batches if r["rows"]] == [0, 1]
    assert {r["kind"] for r in good} == {"started", "batch", "done"}
    assert any(r["kind"] == "failed" and "broken on purpose" in r["message"] for r in rows)
