"""Operators that must not put one entity into one task: equal to plain loops, and bounded per task."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slotwise.operators import events as e
from slotwise.operators.intervals import flag_intervals, flag_treatments
from tests.helpers import DAY0, at, rows_of


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def windows_and_events():
    random.seed(1)
    windows, events = [], []
    for i in range(240):
        user = 7 if i % 3 == 0 else random.randrange(40)
        first = at(random.randrange(2000) / 2)
        windows.append((i, user, first, first + timedelta(hours=random.choice([0, 1, 30, 400, -5]))))
    windows += [(900, 1, None, at(3)), (901, 1, at(0), None), (902, None, at(0), at(9)), (903, 3, datetime(1500, 1, 1), datetime(2900, 1, 1))]
    for i in range(900):
        events.append((i, 7 if i % 3 == 0 else random.randrange(40), at(random.randrange(2000) / 2)))
    return windows, events + [(1000, None, at(1)), (1001, 7, None)]


WINDOW, EVENT = "w long, user long, start timestamp_ntz, end timestamp_ntz", "event long, user long, time timestamp_ntz"


def test_windows_meet_events_in_time_slices(spark, no_broadcast):
    windows, events = windows_and_events()
    stays, rows = spark.createDataFrame(windows, WINDOW), spark.createDataFrame(events, EVENT)
    found = e.events_in_window(stays, rows, "user", slice="2 days")
    pairs = [(w, i) for w, u, a, b in windows for i, v, t in events if u is not None and u == v and a and b and t and a <= t <= b]
    assert rows_of(found.select("w", "event")) == sorted(pairs)
    assert found.columns == ["w", "user", "start", "end", "event", "time"]
    early = e.events_before(stays, rows, "user", slice="2 days")
    assert rows_of(early.select("w", "event")) == sorted((w, i) for w, u, a, _ in windows for i, v, t in events if u is not None and u == v and a and t and t < a)
    plan = plan_of(found)
    assert "_slice" in plan.split("SortMergeJoin")[1].split("\n")[0]
    keep = e.events_in_window(stays, rows, "user", keep_unmatched=True)
    assert {r["w"] for r in keep.collect()} == {w for w, *_ in windows}
    assert e.events_in_window(stays, rows.limit(0), "user").count() == 0


def test_no_slice_holds_the_rows_of_a_hot_entity(spark, no_broadcast):
    windows, events = windows_and_events()
    rows = spark.createDataFrame(events, EVENT)
    found = e.events_in_window(spark.createDataFrame(windows, WINDOW), rows, "user", slice="2 days")
    dealt = re.findall(r"hashpartitioning\((.*?)\), ENSURE", plan_of(found))
    assert len(dealt) == 2 and all("_slice" in d and "user" in d for d in dealt)
    per_slice = rows.dropna().groupBy("user", F.window("time", "2 days")).count().agg(F.max("count")).first()[0]
    hot = rows.where("user = 7").count()
    assert hot > 300 and per_slice < hot / 8


def touched(slots, runs):
    out = []
    for s in slots:
        last = s + timedelta(hours=6) - timedelta(seconds=1)
        out.append(int(any(a <= s <= b or s <= a <= last or s <= b <= last for a, b in runs)))
    return out


@pytest.mark.parametrize("block", [1, 4, 256])
def test_sweep_equals_a_plain_search(spark, block):
    random.seed(2)
    slots = {i: [at(6 * k) for k in range(random.randrange(0, 5), random.randrange(6, 60))] for i in range(12)}
    grid = [(i, s, "x") for i, own in slots.items() for s in own]
    runs = {name: [(random.randrange(14), (a := at(random.randrange(-200, 400))), a + timedelta(hours=random.choice([0, 2, 6, 50, -9]))) for _ in range(60)] for name in ("p", "q")}
    runs["p"] += [(1, datetime(1300, 1, 1), datetime(2900, 1, 1)), (2, None, at(4)), (None, at(1), at(4)), (1, at(3), at(4))]
    schema = "id long, starttime timestamp_ntz, endtime timestamp_ntz"
    frames = {k: spark.createDataFrame(v, schema) for k, v in runs.items()}
    got = flag_treatments(spark.createDataFrame([*grid, (None, at(0), "y")], "id long, slot timestamp_ntz, note string"), frames, block=block)
    assert got.columns == ["id", "slot", "note", "p", "q"]
    want = [(None, at(0), "y", 0, 0)]
    for i, own in slots.items():
        flags = [touched(own, [(a, b) for j, a, b in runs[k] if j == i and a and b]) for k in ("p", "q")]
        want += [(i, s, "x", p, q) for s, p, q in zip(own, *flags, strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_long_run_costs_two_rows(spark, no_broadcast):
    grid = spark.createDataFrame([(1, DAY0)], "id long, slot timestamp_ntz")
    runs = spark.createDataFrame([(1, datetime(1000, 1, 1), datetime(3000, 1, 1))], "id long, starttime timestamp_ntz, endtime timestamp_ntz")
    flagged = flag_intervals(grid, runs, "f")
    assert flagged.first()["f"] == 1
    assert "sequence" not in plan_of(flagged) and "Generate explode" not in plan_of(flagged)
