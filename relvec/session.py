"""Session settings and the shared folder that intermediate tables live in."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

UTC_ZONES = {"UTC", "Etc/UTC", "Z", "GMT", "+00:00"}


def local_session(app: str = "relvec", cores: int | str = 8, shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """Session for tests and benchmarks. A cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def require_utc(spark: SparkSession) -> None:
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_ZONES:
        raise ValueError(f"session time zone must be UTC, got {zone}")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one `spark.checkpoint.dir` names."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call uses; one folder per application, so it can be dropped whole."""
    return f"{shared_dir(spark)}/relvec/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a columnar table to the shared folder and reading it back.

    The written files outlive any executor, and later reads still prune columns and rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if getattr(_passing, "paths", None) is not None:
        _passing.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_passing = threading.local()


@contextmanager
def scratch_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stores by `materialize` inside the block are dropped at its end; none may be read after it."""
    outer, _passing.paths = getattr(_passing, "paths", None), []
    try:
        yield
    finally:
        paths, _passing.paths = _passing.paths, outer
        for path in paths:
            drop(spark, path)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside the block the files of a shuffle go as soon as its query ends, not when the driver happens to collect garbage.

    The setting holds for all threads of the session. A frame that is asked again makes its shuffles again.
    """
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads the path from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
