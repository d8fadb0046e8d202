"""Session defaults, durable lineage cuts and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "inkwell", **conf: str) -> SparkSession:
    """Session for tests and benches; a cluster job brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores if cores != "*" else 8))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: driver and
    executors are one process there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _own_dir()


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="inkwell-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def lineage_cuts(spark: SparkSession) -> None:
    """Give the application a checkpoint folder, unless it has one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def delete_scratch(spark: SparkSession, path: str | None) -> None:
    """Delete a file or folder of our own below the shared folder, if there is one."""
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a table of fewer splits than cores over all cores; others pass unchanged.

    Text work is CPU-bound, and a small file is one split.  A table of many files
    already has its parallelism and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder.

    Unlike a checkpoint it stays columnar, so later passes read only the columns
    they need.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
