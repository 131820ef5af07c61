"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
TSV_OPTIONS = {
    "sep": "\t",
    "header": "true",
    "timestampFormat": TIMESTAMP_FORMAT,
    "timestampNTZFormat": TIMESTAMP_FORMAT,
}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in floating columns, so that averages skip missing values."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType | FloatType)]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floating}) if floating else df


def read_table(
    spark: SparkSession,
    name: str,
    columns: Sequence[str] | None = None,
    base: str | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """A stored table: ``<base>/<name>.parquet`` or, without ``base``, a catalog table.

    A given schema saves looking into the files.
    """
    if base is None:
        df = spark.read.table(name)
    else:
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int,
    upper: int,
    num_partitions: int,
    columns: Sequence[str] | None = None,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table read in parallel ranges of ``partition_column``.

    The bounds only set the stride: rows outside them are still read.
    """
    df = spark.read.jdbc(
        url, table, column=partition_column, lowerBound=lower, upperBound=upper,
        numPartitions=num_partitions, properties=dict(properties or {}),
    )
    return df.select(*columns) if columns else df


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Tab-separated text with a header; the schema is given, never inferred."""
    reader = spark.read.options(**TSV_OPTIONS).option("mode", "FAILFAST")
    df = reader.option("enforceSchema", False).schema(schema).csv(path)
    return nan_to_null(df)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header, one file per partition."""
    df.write.mode("overwrite").options(**TSV_OPTIONS).csv(path)


def materialize(
    df: DataFrame,
    name: str,
    path: str | None = None,
    partition_by: Sequence[str] = (),
    bucket_by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Replace a stored table by the rows of ``df`` and return a scan of it.

    With ``path`` the rows go to parquet files at ``path/name``, otherwise to a catalog table,
    which may be bucketed so that later joins and groupings on the bucket columns do not
    shuffle.  A stored table has an exact size, so the planner can decide on a broadcast.
    """
    spark = df.sparkSession
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path is not None:
        if bucket_by:
            raise ValueError("bucketing needs a catalog table")
        writer.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")
    if bucket_by:
        writer = writer.bucketBy(buckets or 200, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(name)
    return spark.read.table(name)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Store a report table (coverage, completeness, importance)."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def append_report(df: DataFrame, path: str, run_id: str) -> None:
    """Add the rows of one run to a report table, in place of what the same run wrote before.

    The run is a partition of its own, so a repeated or retried write replaces only that, and
    readers see all runs.  Spark's committer moves the files when all tasks are done.
    """
    rows = df.withColumn("run_id", F.lit(run_id))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(path)


def read_report(spark: SparkSession, path: str, runs: Sequence[str] | None = None) -> DataFrame:
    """Rows of all runs, or of some of them, with ``run_id``; other runs' files are not read."""
    spark_schema = spark.read.parquet(path).schema
    fields = [f for f in spark_schema.fields if f.name != "run_id"]
    rows = spark.read.schema(StructType([*fields, StructField("run_id", StringType())])).parquet(path)
    return rows if runs is None else rows.filter(F.col("run_id").isin(list(runs)))


def run_record(
    df: DataFrame, id: str, label: str, features: Sequence[str], params: Mapping[str, Any]
) -> DataFrame:
    """One row that describes a run: its parameters and the counts of its supervised set.

    Append it with ``write.mode("append")``.
    """
    per_id = df.groupBy(id).agg(F.max(label).alias("_label"), F.count("*").alias("_steps"))
    counts = per_id.agg(
        F.count("*").alias("sample_num"),
        F.avg(F.col("_label").cast("double")).alias("positive_ratio"),
        F.max("_steps").alias("time_seq_length"),
    )
    fixed = [F.lit(value).alias(name) for name, value in params.items()]
    return counts.select(*fixed, F.lit(len(features)).cast("bigint").alias("feature_num"), "*")
