"""Incremental embedding and feature jobs: only new texts and new interaction files are processed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from relvec.operators.encode import Encoder, encode_dictionary
from relvec.operators.features import cosine_features, store_usage
from relvec.operators.text_dictionary import completion, pending, with_text_keys
from relvec.schema import ROLE_TEXT, ROLES, require_unique
from relvec.session import exists, materialize, scratch_path, shuffle_partitions
from relvec.sources.bucketed import entries_for
from relvec.sources.tables import read_store, write_store


PROGRESS_COLUMNS = "slice int, texts long, finished long, total long"


def _existing_store(spark: SparkSession, folder: str) -> DataFrame | None:
    return require_unique(read_store(spark, folder), ["role", "text_key"], "store") if exists(spark, folder) else None


def embed_pending(
    spark: SparkSession, dictionary: DataFrame, folder: str, make_encoder: Callable[[], Encoder], dim: int,
    slices: int = 8, texts_per_commit: int = 1_000_000,
) -> int:
    """Append vectors for texts the store lacks; return how many there were. Nothing is written when none are.

    Pending texts are stored by slice, a hash of their key, and each slice is read, embedded and committed before the next one
    starts. There are enough slices that none holds much more than `texts_per_commit` texts, so a job that dies loses that many
    at most, however large the job. The rows a slice wrote are counted as they are written and added to the progress table
    beside the store.
    """
    done = _existing_store(spark, folder)
    todo = materialize(dictionary if done is None else pending(dictionary, done), "pending")
    slices = max(slices, -(-todo.count() // texts_per_commit))
    path = scratch_path(spark, "slices")
    number = F.pmod(F.xxhash64("role", "text_key"), F.lit(slices)).cast("int")
    todo.withColumn("_slice", number).repartition("_slice", F.pmod(F.hash("text_key"), F.lit(shuffle_partitions(spark)))).write.partitionBy("_slice").parquet(path)
    stored = spark.read.parquet(path) if slices and todo.take(1) else todo.withColumn("_slice", number)
    sizes = {r["_slice"]: r["count"] for r in stored.groupBy("_slice").count().collect()}  # one row per slice
    finished = 0
    for i in sorted(sizes):
        seen = Observation(f"slice-{i}")
        encoded = encode_dictionary(stored.where(F.col("_slice") == i).drop("_slice"), make_encoder, dim)
        write_store(encoded.observe(seen, F.count(F.lit(1)).alias("texts")), folder)
        finished += seen.get["texts"]
        written = [(int(i), seen.get["texts"], finished, sum(sizes.values()))]
        spark.createDataFrame(written, PROGRESS_COLUMNS).coalesce(1).write.mode("append").parquet(f"{folder}_progress")
    return finished


def embedding_progress(spark: SparkSession, dictionary: DataFrame, folder: str) -> DataFrame:
    """Finished, total and finished share per role."""
    done = _existing_store(spark, folder)
    done = dictionary.limit(0) if done is None else done
    return completion(dictionary, done, ["role"], ["role", "text_key"])


def feature_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    store_folder: str,
    dims: Sequence[int],
    target: str,
    checkpoint: str,
    files_per_batch: int = 64,
    texts: bool = True,
) -> StreamingQuery:
    """Process every interaction file that has not been processed, then stop.

    With `texts` off, the features carry the ids of the texts without the texts themselves, which then are read from the
    source once and written nowhere: disk grows with the number of rows and not with the length of their texts.

    The checkpoint records the files of each micro-batch, so a restart goes on after the last committed one. A batch
    that is repeated after a failure overwrites its own directory.
    """

    # One snapshot of the store, measured once, serves all batches of this start.
    store = read_store(spark, store_folder)
    used = store_usage(store)

    def write_batch(rows: DataFrame, number: int) -> None:
        # The batch is stored with its keys; its files are read, and its rows counted, once. Only hashes travel through
        # the lookups. A bucketed store stays where it is, and a batch with few texts reads only their buckets.
        seen = Observation(f"batch-{number}")
        keyed = with_text_keys(rows)
        batch = materialize(keyed if texts else keyed.drop(*ROLE_TEXT.values()), "batch")
        needed = entries_for(store, batch, [f"{role}_text_key" for role in ROLES])
        features = cosine_features(batch, needed, dims, used=used, once_per_triple=True)
        features.observe(seen, F.count(F.lit(1)).alias("rows")).withColumn("_batch", F.lit(number)).write.partitionBy(
            "_batch", "split"
        ).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)
        # A repeated batch replaces its own row.
        spark.createDataFrame([(number, seen.get["rows"])], "batch long, rows long").coalesce(1).write.mode("overwrite").parquet(
            f"{target}_progress/number={number}"
        )

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_stream_features(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("_batch")


def stream_progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Rows that each batch of one start read."""
    rows = [(int(p["batchId"]), int(p["numInputRows"])) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch long, rows long")


def written_progress(spark: SparkSession, target: str) -> DataFrame:
    """Rows that each batch wrote, over all starts, as counted while they were written."""
    if not exists(spark, f"{target}_progress"):
        return spark.createDataFrame([], "batch long, rows long")
    return spark.read.parquet(f"{target}_progress").select("batch", "rows")
