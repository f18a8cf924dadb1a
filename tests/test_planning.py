"""Scorecards, newest items, multi-line shares and the ledger on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.operators import planning, upsert


def test_scorecard_of_weeks_with_and_without_a_week_before(spark):
    monday = dt.date(2024, 1, 1)
    rows = [
        ("a", monday, True, True, 3, 10.0, None), ("a", monday, True, False, 0, 5.0, "flaky"), ("a", monday, False, True, 2, 1.0, "Build"), ("a", monday, False, False, 9, 0.0, "flaky"),
        ("a", monday + dt.timedelta(7), True, True, 1, 4.0, "b"), ("a", monday + dt.timedelta(7), None, True, None, None, "a"),
        ("a", monday + dt.timedelta(21), False, False, 1, 4.0, None), ("b", monday, True, False, 1, 2.0, None),
    ]
    items = spark.createDataFrame(rows, "team string, week_start date, planned boolean, merged boolean, rounds int, cost double, failure string")
    got = {(r.team, (r.week_start - monday).days): r for r in planning.scorecard(items).collect()}
    first, second = got["a", 0], got["a", 7]
    assert (first.planned, first.planned_merged, first.planned_pct, first.rework_pct, first.cost_per_merge, first.top_failure, first.rework_pct_trend) == (2, 1, 50.0, 50.0, 8.0, "flaky", None)
    assert (second.planned_pct, second.rework_pct, second.cost_per_merge, second.top_failure) == (100.0, 0.0, 2.0, "a")
    assert (second.planned_pct_trend, second.rework_pct_trend, second.cost_per_merge_trend) == ("up", "down", "down")
    assert got["a", 21].planned_pct is None and got["a", 21].planned_pct_trend is None and got["b", 0].cost_per_merge is None
    assert planning.scorecard(items.limit(0)).count() == 0


def test_newest_items_and_their_labels(spark):
    items = spark.createDataFrame([("t", i, None if i == 9 else i // 2) for i in range(10)] + [("u", 50, 1)], "team string, item int, updated_at int")
    labels = spark.createDataFrame([(8, "b"), (8, "a"), (8, "b"), (1, "x"), (50, None)], "item int, label string")
    got = [(r.team, r.item, r.rank, r.labels) for r in planning.newest(items, labels, most=3).orderBy("team", "rank").collect()]
    assert got == [("t", 8, 1, "a,b"), ("t", 6, 2, ""), ("t", 7, 3, ""), ("u", 50, 1, "")]


def test_unknown_messages_leave_the_denominator(spark):
    rows = [("s", "one", 0), ("s", "one\n\nbody", 1), ("s", "one\n\nCo-Authored-By: x <y>\n", 1), ("s", None, 1), ("t", None, 0), ("u", "s\nbody", 0)]
    got = {r.k: tuple(r)[1:] for r in planning.multiline_share(spark.createDataFrame(rows, "k string, message string, is_ai_assisted int"), ["k"]).collect()}
    assert got == {"s": (3, 33.333333, 66.666667, 100.0, 50.0), "u": (1, 100.0, 0.0, 0.0, None)}


def test_a_ledger_keeps_what_it_has(spark, tmp_path):
    ledger = upsert.Ledger(str(tmp_path / "l"))
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "run_id int, detail string")
    ledger.append(rows, "x")
    ledger.append(rows.where("run_id = 1"), "y")
    ledger.append(rows, "x")
    assert sorted((r.run_id, r.detail) for r in ledger.read(spark).collect()) == [(1, "a")] * 4 + [(2, "b")]
    assert ledger.read(spark).where(F.col("run_id") == 2).count() == 1
