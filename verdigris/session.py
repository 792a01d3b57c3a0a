"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: SQL settings that the library is tuned for; a value that the launcher or the session has stays.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def _launched() -> bool:
    """Whether spark-submit, a shell or a running session owns master and memory."""
    return ("PYSPARK_GATEWAY_PORT" in os.environ or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")
            or SparkSession.getActiveSession() is not None)


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "verdigris") -> SparkSession:
    """A session with ``DEFAULTS`` where nothing else is set.

    On a cluster the launcher owns master, memory and shuffle partitions.
    Without a launcher this is a local run, as in tests and the bench:
    ``local[$BENCH_CPUS]``, as many shuffle partitions, 8 GB for the driver.
    """
    b = SparkSession.builder.appName(app)
    if master or not _launched():
        cpus = os.environ.get("BENCH_CPUS", "8")
        b = (b.master(master or f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g")).config("spark.sql.shuffle.partitions", cpus))
    spark = b.getOrCreate()
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session. Only a local master (tests, local runs) gets a
    fresh folder under /tmp when it is unset; anywhere else executors would
    write to different disks, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="verdigris-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts lineage with one computation (an eager ``checkpoint()`` computes the
    plan twice: once to count, once to write). The table lives in the shared
    folder, so it survives executor loss.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/materialized/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Whether a query's shuffle files go as soon as it has ended (Spark 4.1), not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind, so a job of many steps holds those of one at a time."""
    had = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, had)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that a step has written for the next one alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
