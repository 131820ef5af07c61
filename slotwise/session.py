"""Session helpers: a test/bench session, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("slotwise")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate data, ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.  On a cluster a missing
    setting is an error: a machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="slotwise-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


#: Folders of the scopes that are open, the innermost last.
_scopes: list[str] = []


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """A scope that owns the tables stored inside it and deletes them when it ends, also after an error.

    What is needed afterwards has to be written elsewhere before: a result that still reads a stored
    table can't be computed once the scope is over.
    """
    folder = f"{shared_folder(spark)}/scope-{uuid.uuid4().hex}"
    _scopes.append(folder)
    try:
        yield folder
    finally:
        _scopes.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tables_folder(spark: SparkSession) -> str:
    """Where ``stored`` writes now: the folder of the innermost scope, or else the shared one."""
    return _scopes[-1] if _scopes else shared_folder(spark)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries inside delete their shuffle files as they end; else these stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` to a table of its own in ``folder``, or ``tables_folder``, and return a scan of it.

    The scan starts a short new lineage on files that outlive any executor, reads only the
    columns it needs, and has a known size, from which the planner decides on broadcasts.
    """
    spark = df.sparkSession
    path = f"{folder or tables_folder(spark)}/table-{uuid.uuid4().hex}"
    with brief_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fetched(df: DataFrame) -> DataFrame:
    """A small fitted table as a local relation, so that plans using it do not fit it again.

    For results with one row per column of a table, which the schema bounds.
    """
    return df.sparkSession.createDataFrame(df.toArrow())
