"""Events stored by part and bucket: plans without shuffles, pruned parts, hot entities spread."""

import datetime as dt
import re
import uuid

import pytest
from pyspark.sql import functions as F

from slotwise.plans.catalog import QUERIES
from slotwise.sources import layout as l
from tests.test_plans import FOLDER, plan_of, shuffles

SCHEMA = "id long, at timestamp_ntz, v double"
START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


@pytest.fixture
def table(spark, tmp_path):
    names = []

    def make(rows, **kwargs):
        names.append(f"t_{uuid.uuid4().hex}")
        return l.store_sliced(spark.createDataFrame(rows, SCHEMA), names[-1], "id", "at", str(tmp_path / names[-1]), **kwargs)

    yield make
    l.drop_sliced(spark, *names)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["stored_pivot", "stored_window_pivot"])
def test_no_shuffle_under_the_pivot(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert shuffles(plan) == [] and "Bucketed: true" in plan
    assert ("SortMergeJoin" in plan) == (name == "stored_window_pivot")


def test_parts_are_pruned(spark):
    rows = QUERIES["stored_part_rows"](spark, FOLDER)
    assert "dynamicpruning" in plan_of(rows)


def test_filter_on_the_part_reads_its_folder_only(table):
    rows = table([(i, at(24 * 20 * i), 1.0) for i in range(6)])
    some = rows.filter(F.col("part") == "2024-02")
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan_of(some))
    assert {r.id for r in some.collect()} == {2} and len(some.inputFiles()) == 1


def test_hot_entity_fills_all_buckets(table):
    """One entity holds half of all rows; no bucket holds more than a few of its days."""
    rows = table([(0, at(i), 1.0) for i in range(24 * 64)] + [(1 + i, at(i % 700), 1.0) for i in range(24 * 64)], buckets=8)
    bucket = F.regexp_extract(F.input_file_name(), r"_(\d{5})\.c\d+", 1)
    counts = [r["count"] for r in rows.filter("id = 0").groupBy(bucket).count().collect()]
    assert len(counts) == 8 and max(counts) < 24 * 64 / 3


def test_windows_meet_events_once(spark, table, tmp_path):
    events = [(i % 5, at(i * 7), float(i)) for i in range(200)] + [(1, None, 0.0), (None, at(3), 0.0), (1, at(7), 1.0), (1, at(7), 1.0)]
    spans = [
        (0, at(0), at(500)), (0, at(100), at(101)), (1, at(7), at(7)), (2, at(900), at(100)), (3, None, at(9)),
        (4, at(-9000), dt.datetime(9999, 1, 1)), (1, at(-500), at(-400)), (None, at(0), at(900)),
    ]
    stored = table(events)
    windows = spark.createDataFrame(spans, "id long, first timestamp_ntz, last timestamp_ntz")
    name = f"w_{uuid.uuid4().hex}"
    sliced = l.store_windows(windows, name, "id", "first", "last", str(tmp_path / name), stored)
    got = l.join_sliced(stored, sliced, "id", "at", "first", "last").select("id", "at", "v", "first")
    want = [
        (i, t, v, a) for i, t, v in events for j, a, b in spans
        if i is not None and i == j and t is not None and a is not None and a <= t <= b
    ]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    l.drop_sliced(spark, name)


def test_empty_table(spark, table, tmp_path):
    stored = table([])
    windows = spark.createDataFrame([(0, at(0), at(5))], "id long, first timestamp_ntz, last timestamp_ntz")
    name = f"w_{uuid.uuid4().hex}"
    sliced = l.store_windows(windows, name, "id", "first", "last", str(tmp_path / name), stored)
    assert l.join_sliced(stored, sliced, "id", "at", "first", "last").count() == 0
    l.drop_sliced(spark, name)
