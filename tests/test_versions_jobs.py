"""Versioned tables, approval that writes, and jobs that are claimed once."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodemap.operators.review import Spec
from lodemap.sources.versions import NoVersion, VersionConflict, Versions, approve
from lodemap.streaming import jobs

NOON = datetime.datetime(2024, 5, 1, 12)


def test_versions_are_read_whole_or_not_at_all(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    with pytest.raises(NoVersion):
        v.read("orders")
    assert v.last("orders") == 0 and v.write(spark.range(3), "orders") == 1
    broken = spark.range(10).withColumn("id", F.expr("if(id = 7, raise_error('broken'), id)"))
    with pytest.raises(Exception, match="broken"):
        v.write(broken, "orders")
    assert v.last("orders") == 1 and v.read("orders").count() == 3
    assert v.write(spark.range(5), "orders", note="more") == 2
    assert (v.read("orders").count(), v.read("orders", 1).count()) == (5, 3)
    with pytest.raises(VersionConflict):
        v.write(spark.range(9), "orders", version=2)
    with pytest.raises(ValueError):
        v.write(spark.range(1), "../orders")
    with pytest.raises(NoVersion):
        v.read("orders", 9)


def test_latest_by_kind_and_names_in_use(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    for name, kind in (("a", "profile"), ("a", "profile"), ("b", "profile"), ("c", "links")):
        v.write(spark.range(1), name, kind)
    assert {(r["name"], r["version"]) for r in v.latest("profile").collect()} == {("a", 2), ("b", 1)}
    assert v.names_in_use().count() == 4


def test_approval_writes_tables_links_and_state(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    raw = {"sales": spark.createDataFrame([(0, "id", "amount"), (1, "1", "1.5"), (2, "2", "2")], "_row_id long, c0 string, c1 string")}
    specs = {"sales": Spec(0, (("id", "int", None), ("amount", "float", 100000.0))), "gone": Spec(0, ())}
    link = {"tab_a": "sales", "col_a": "id", "tab_b": "sales", "col_b": "id", "direction": "one_to_one"}
    assert approve(v, "s1", raw, specs, [link, {**link, "tab_b": "gone"}], overview="Sales") == {"sales": 1}
    assert sorted(r["amount"] for r in v.read("s1.sales").collect()) == [150000.0, 200000.0]
    assert [(r["score"], r["origin"]) for r in v.read("s1.links").collect()] == [(1.0, "user_added")]
    assert tuple(v.read("s1.state").first()) == ("s1", "ready", "approved", "Sales")
    bad = {"sales": raw["sales"].withColumn("c1", F.expr("if(_row_id = 2, raise_error('unreadable'), c1)"))}
    with pytest.raises(Exception, match="unreadable"):
        approve(v, "s1", bad, specs, [], overview="other")
    assert v.read("s1.state").first()["overview"] == "Sales" and v.read("s1.sales").count() == 2
    assert approve(v, "s1", raw, specs, []) == {"sales": 2} and v.read("s1.links").count() == 0


def inbox(spark, path, ids, kind="work"):
    rows = [(i, kind, None, NOON) for i in ids]
    spark.createDataFrame(rows, "job_id string, kind string, payload string, created_at timestamp").coalesce(1).write.mode("append").parquet(path)


def state(versions):
    return {r["job_id"]: (r["status"], r["attempts"]) for r in jobs.state_of(versions).collect()}


def test_jobs_are_claimed_once_and_tried_again(spark, tmp_path):
    source, root = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    inbox(spark, source, ["a", "b", "bad", "a", None])

    def work(due):
        return due.select("job_id", (F.col("job_id") != "bad").alias("ok"), F.lit("said").alias("message"))

    versions = jobs.run_jobs(spark, source, root, work, NOON)
    assert state(versions) == {"a": ("succeeded", 1), "b": ("succeeded", 1), "bad": ("failed", 3)}
    before = versions.last("jobs")
    jobs.run_jobs(spark, source, root, work, NOON)  # nothing new
    assert versions.last("jobs") == before
    inbox(spark, source, ["a", "c"])  # a is known
    assert state(jobs.run_jobs(spark, source, root, work, NOON)) == {"a": ("succeeded", 1), "b": ("succeeded", 1), "bad": ("failed", 3), "c": ("succeeded", 1)}


def test_a_claim_that_runs_again_changes_nothing(spark, tmp_path):
    versions, seen = Versions(spark, f"file://{tmp_path}/s"), []
    new = spark.createDataFrame([("a", "k", None, NOON)], "job_id string, kind string, payload string, created_at timestamp")

    def broken(due):
        raise RuntimeError("lost")

    def work(due):
        seen.append(due.count())
        return due.select("job_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("message"))

    with pytest.raises(RuntimeError):
        jobs.step(versions, new, 0, broken, NOON)
    assert state(versions) == {"a": ("running", 1)}
    for _ in range(2):
        jobs.step(versions, new, 0, work, NOON)
    assert state(versions) == {"a": ("succeeded", 1)} and seen == [1] and versions.last("jobs") == 2


def test_a_lock_that_has_passed_is_claimed_by_another(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/s")
    new = spark.createDataFrame([("a", "k", None, NOON), ("b", "k", None, NOON)], "job_id string, kind string, payload string, created_at timestamp")
    silent = lambda due: due.select("job_id", F.lit(True).alias("ok"), F.lit("").alias("message")).where("job_id = 'b'")
    jobs.step(versions, new, 0, silent, NOON)
    assert state(versions) == {"a": ("running", 1), "b": ("succeeded", 1)}
    work = lambda due: due.select("job_id", F.lit(True).alias("ok"), F.lit("").alias("message"))
    jobs.step(versions, new.limit(0), 1, work, NOON + datetime.timedelta(seconds=60))
    assert state(versions)["a"] == ("running", 1)
    jobs.step(versions, new.limit(0), 2, work, NOON + datetime.timedelta(seconds=1801))
    assert state(versions)["a"] == ("succeeded", 2)
