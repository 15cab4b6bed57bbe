"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "contactloom", cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is spark.checkpoint.dir of the session. Only where that is unset and all tasks run in
    this process, a temporary folder takes its place.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", "")
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df, marked for broadcast only if it is counted to hold at most `most` rows; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives this package to the session's Python workers, once; for clusters where it is not installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), package.name)
        context.addPyFile(shutil.make_archive(str(archive), "zip", package.parent, package.name))
        _shipped.add(context.applicationId)
    return spark
