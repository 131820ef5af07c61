"""Files, tables, run records."""

import pytest
from pyspark.sql import functions as F

from slotwise.dictionaries import LEGACY_NAMES
from slotwise.operators.cleaning import feature_columns, harmonize_columns, label_last
from slotwise.session import shared_folder, stored
from slotwise.sources import (
    materialize,
    nan_to_null,
    read_table,
    read_tsv,
    run_record,
    write_report,
    write_tsv,
)
from tests.helpers import at, rows_of

ROWS = [(1, at(1, microseconds=123456), 1.5, "a b"), (2**53 + 1, at(), None, None)]
SCHEMA = "id bigint, time timestamp_ntz, v double, s string"


def test_tsv_round_trip_keeps_keys_times_and_nulls(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    write_tsv(df, str(tmp_path / "out"))
    assert rows_of(read_tsv(spark, str(tmp_path / "out"), SCHEMA)) == ROWS


def test_tsv_nan_becomes_null(spark, tmp_path):
    (tmp_path / "in.tsv").write_text("id\tv\n1\tNaN\n2\t3.5\n")
    assert rows_of(read_tsv(spark, str(tmp_path / "in.tsv"), "id bigint, v double")) == [
        (1, None), (2, 3.5)
    ]


def test_nan_to_null_touches_floats_only(spark):
    df = spark.createDataFrame([(1, float("nan"), "x")], "a int, b double, c string")
    assert rows_of(nan_to_null(df)) == [(1, None, "x")]


def test_materialize_replaces(spark, tmp_path):
    base = str(tmp_path)
    materialize(spark.range(5), "t", path=base)
    scan = materialize(spark.range(3), "t", path=base)
    assert scan.count() == 3
    assert spark.read.parquet(f"{base}/t").count() == 3


def test_bucketed_table_is_grouped_without_a_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    table = materialize(rows, "slotwise_bucketed", bucket_by=["k"], buckets=4)
    try:
        counted = table.groupBy("k").count()
        assert counted.count() == 50
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
        assert read_table(spark, "slotwise_bucketed", ["k"]).columns == ["k"]
    finally:
        spark.sql("DROP TABLE slotwise_bucketed")


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5)], "feature string, coverage double")
    write_report(df, str(tmp_path / "r"))
    assert rows_of(spark.read.csv(str(tmp_path / "r"), header=True)) == [("a", "0.5")]


def test_run_record_is_one_appendable_row(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (2, 0, 1.0)], "id bigint, y int, a double")
    for seed in (1, 2):
        record = run_record(df, "id", "y", ["a"], {"random_seed": seed})
        record.write.mode("append").parquet(str(tmp_path / "runs"))
    assert rows_of(spark.read.parquet(str(tmp_path / "runs"))) == [
        (1, 1, 2, 0.5, 2), (2, 1, 2, 0.5, 2)
    ]


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "patient_id int, akistage int, b int")
    named = harmonize_columns(df, LEGACY_NAMES)
    assert named.columns == ["stay_id", "aki_stage", "b"]
    assert label_last(named, "aki_stage").columns == ["stay_id", "b", "aki_stage"]
    assert feature_columns(named, ["stay_id", "aki_stage"]) == ["b"]


def test_stored_tables_live_in_the_shared_folder(spark):
    scan = stored(spark.range(10))
    assert scan.count() == 10
    folder = shared_folder(spark).rsplit("/", 1)[-1]
    assert all(f"/{folder}/table-" in name for name in scan.inputFiles())


def files_under(folder):
    from pathlib import Path

    return [p for p in Path(folder.removeprefix("file:")).rglob("*") if p.is_file()]


def test_workspace_deletes_what_was_stored_in_it(spark):
    from slotwise.session import stored, workspace

    with workspace(spark) as folder:
        assert stored(spark.range(5)).count() == 5 and files_under(folder)
        with workspace(spark) as inner:
            stored(spark.range(3))
        assert not files_under(inner) and files_under(folder)
    assert not files_under(folder)
    with pytest.raises(RuntimeError), workspace(spark) as failed:
        stored(spark.range(5))
        raise RuntimeError
    assert not files_under(failed)
    outside = stored(spark.range(2))
    assert outside.count() == 2


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size())}

    before, name = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    table = stored(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert not [x for x in shuffled() - before if x.startswith("shuffle_")]
    assert spark.conf.get(name) == setting and table.count() == 7


def test_report_of_a_run_replaces_itself_only(spark, tmp_path):
    from slotwise.sources import append_report, read_report

    path = str(tmp_path / "report")
    append_report(spark.range(4), path, "a")
    append_report(spark.range(2), path, "b")
    append_report(spark.range(3), path, "a")
    assert read_report(spark, path).groupBy("run_id").count().orderBy("run_id").collect() == [("a", 3), ("b", 2)]
    assert read_report(spark, path, ["b"]).count() == 2
