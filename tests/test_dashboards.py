"""Dashboards of organisations and stretches of kept events on fixtures."""

import datetime
import random

from lodemap.operators import dashboards, usage
from lodemap.operators.dashboards import MEAN, SUM, Measure

AT = datetime.datetime


def fixture(spark):
    members = spark.createDataFrame(
        [(1, 10, "a", True), (1, 11, "b", True), (1, 12, "gone", False), (2, 10, "a", True), (3, 30, "odd", None)], "org int, user int, name string, active boolean"
    )
    files = spark.createDataFrame(
        [(1, 10, 5.0, AT(2024, 2, 1)), (1, 10, 7.0, AT(2024, 1, 31, 23, 59)), (1, 12, 100.0, AT(2024, 2, 29, 23)), (1, None, 1.0, AT(2024, 2, 3)), (2, 10, None, None), (9, 90, 4.0, AT(2024, 3, 1))],
        "org int, user int, size double, at timestamp_ntz",
    )
    turns = spark.createDataFrame([(1, 10, 100.0), (1, 10, None), (1, 11, 400.0), (1, 11, 100.0)], "org int, user int, ms double")
    return members, [
        Measure("files", files), Measure("storage", files, SUM, "size", members_only=True), Measure("month", files, SUM, "size", "at"), Measure("month_files", files, moment="at"), Measure("ms", turns, MEAN, "ms"),
    ]


def test_users_are_the_active_members_with_or_without_facts(spark):
    got = sorted(tuple(r) for r in dashboards.users(*fixture(spark), "2024-02").collect())
    assert got == [(1, 10, "a", 2, 12.0, 5.0, 1, 100.0), (1, 11, "b", 0, 0.0, 0.0, 0, 250.0), (2, 10, "a", 1, 0.0, 0.0, 0, None)]


def test_totals_count_what_is_of_no_member_too(spark):
    got = sorted((tuple(r) for r in dashboards.totals(*fixture(spark), "2024-02").collect()), key=lambda r: (r[1], r[0] or 0))
    assert got == [
        (1, False, 2, 4, 12.0, 106.0, 3, 200.0), (2, False, 1, 1, 0.0, 0.0, 0, None), (3, False, 0, 0, 0.0, 0.0, 0, None), (9, False, 0, 1, 0.0, 0.0, 0, None),
        (None, True, 3, 6, 12.0, 106.0, 3, 200.0),
    ]
    members, measures = fixture(spark)
    empty = dashboards.totals(members.limit(0), [Measure(m.name, m.rows.limit(0), m.kind, m.amount, m.moment) for m in measures], "2024-02").collect()
    assert [tuple(r) for r in empty] in ([], [(None, True, 0, 0, 0.0, 0.0, 0, None)])


def test_facts_meet_in_one_shuffle_after_partial_sums(spark):
    members, measures = fixture(spark)
    plan = dashboards.sums(measures, "2024-02")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Union") == 1 and "partial_sum" in plan


def test_recent_events_by_organisation(spark):
    events = spark.createDataFrame([(i % 2, i, AT(2024, 1, 1) if i < 8 else None) for i in range(10)], "org int, id int, at timestamp_ntz")
    got = sorted((r["org"], r["rank"], r["id"]) for r in dashboards.recent(events, "id", "at", 2).collect())
    assert got == [(0, 1, 6), (0, 2, 4), (1, 1, 7), (1, 2, 5)]


def test_stretches_keep_what_a_walk_over_all_keeps(spark):
    rng, rows, start = random.Random(7), [], AT(2024, 3, 30, 22)
    for user in (1, 1, 1, 2, 3, None):
        at = start
        for _ in range(300):
            at += datetime.timedelta(seconds=rng.choice([0, 1, 59, 300, 599, 600, 601, 4000]))
            rows.append((len(rows), user, at))
    rows.append((len(rows), 3, None))
    for kind in ("timestamp_ntz", "timestamp"):
        df = spark.createDataFrame(rows, f"event_id int, user_id int, ts {kind}")
        kept, last = [], {}
        for i, u, t in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[1], r[2], r[0])):
            if u not in last or t - last[u] >= datetime.timedelta(minutes=10):
                last[u] = t
                kept.append((u, i))
        assert sorted(tuple(r) for r in usage.spaced(df).collect()) == sorted(kept)
