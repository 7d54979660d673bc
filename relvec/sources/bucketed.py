"""A vector store that is bucketed and sorted by text key, so that joins on the key never move it.

The folder is one of parquet files by role, as a plain store's, and any reader can read it as such. What makes it bucketed is
the number of buckets, a one-row table beside it, that is written after the first vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relvec.schema import STORE_SCHEMA
from relvec.session import exists, shuffle_partitions

# Keys that a scan is told one by one. More of them would touch nearly all buckets anyway.
LISTED_KEYS = 1000


def store_buckets(spark: SparkSession, folder: str) -> int | None:
    """Number of buckets of a store, None for a plain one."""
    marker = f"{folder}_buckets"
    return spark.read.schema("buckets int").parquet(marker).first()["buckets"] if exists(spark, marker) else None


def _table(spark: SparkSession, folder: str, buckets: int) -> str:
    """Name of the session's table over the folder; the files stay where they are when the session ends."""
    name = f"relvec_store_{hashlib.sha256(f'{folder} {buckets}'.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STORE_SCHEMA.fields)
        place = folder.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (role) "
            f"CLUSTERED BY (text_key) SORTED BY (text_key) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    if exists(spark, folder):
        spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")  # the folders that are there now, whoever wrote them
    spark.catalog.refreshTable(name)
    return name


def write_bucketed_store(store: DataFrame, folder: str, mode: str = "append", buckets: int | None = None) -> None:
    """Write vectors by role and bucket. One task writes a bucket, so each commit adds one file per role and bucket.

    A store keeps its number of buckets (the session's shuffle partitions if none is given); another one, or vectors added
    to a plain store, is an error.
    """
    spark = store.sparkSession
    there = store_buckets(spark, folder)
    if there is None and mode == "append" and exists(spark, folder):
        raise ValueError(f"{folder} holds a store without buckets")
    if there is not None and buckets not in (None, there):
        raise ValueError(f"{folder} has {there} buckets, not {buckets}")
    number = there or buckets or shuffle_partitions(spark)
    dealt = store.select(*STORE_SCHEMA.names).repartition(number, "text_key")
    dealt.write.insertInto(_table(spark, folder, number), overwrite=mode == "overwrite")
    if there is None:
        spark.createDataFrame([(number,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{folder}_buckets")


def read_bucketed_store(spark: SparkSession, folder: str) -> DataFrame:
    buckets = store_buckets(spark, folder)
    if buckets is None:
        raise ValueError(f"{folder} holds no store with buckets")
    return spark.table(_table(spark, folder, buckets)).select(*STORE_SCHEMA.names)


def entries_for(store: DataFrame, rows: DataFrame, keys: Sequence[str], listed: int = LISTED_KEYS) -> DataFrame:
    """The store without buckets that rows with few different keys can't need; with more keys, the store as it is.

    No entry that a row needs is lost. The keys are narrow columns of `rows`, counted in two steps; at most `listed` of them
    reach the driver, and a scan told them reads their buckets, and in those the pages that can hold them.
    """
    found = rows.select(F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL").distinct().limit(listed + 1).collect()
    return store if len(found) > listed else store.where(F.col("text_key").isin([r["key"] for r in found]))
