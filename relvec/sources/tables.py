"""Parquet scans and sinks for splits, stores, features and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relvec.functions.probabilities import confidence, top_class
from relvec.operators.labels import probability_columns
from relvec.schema import METADATA_COLUMNS, ROLE_TEXT, SPLITS, STORE_SCHEMA, present, require_columns
from relvec.sources.bucketed import read_bucketed_store, store_buckets


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Use every core on a scan of few files; a scan that already fills the cores stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)


def read_splits(spark: SparkSession, folder: str, splits: Sequence[str] = SPLITS) -> DataFrame:
    """`<folder>/<split>.parquet` per split as one table with a `split` column; a missing file raises."""
    out = None
    for split in splits:
        frame = spark.read.parquet(f"{folder}/{split}.parquet").withColumn("split", F.lit(split))
        require_columns(frame, ROLE_TEXT.values(), f"{split} split")
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def write_splits(df: DataFrame, folder: str, splits: Sequence[str] = SPLITS) -> None:
    for split in splits:
        df.where(F.col("split") == split).drop("split").write.mode("overwrite").parquet(f"{folder}/{split}.parquet")


def write_features(df: DataFrame, folder: str) -> None:
    """One directory per split; only the splits present in `df` are replaced."""
    df.write.partitionBy("split").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def read_features(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """Feature rows; asking for one split prunes the other directories."""
    df = spark.read.parquet(folder)
    require_columns(df, ["query_text_id", "user_text_id", "candidate_text_id"], "feature table")
    return df if split is None else df.where(F.col("split") == split)


def write_store(store: DataFrame, folder: str, mode: str = "append") -> None:
    """Vectors as `array<tinyint>`, one directory per role. Appending is how an interrupted run goes on."""
    store.select(*STORE_SCHEMA.names).write.partitionBy("role").mode(mode).parquet(folder)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """A store, plain or bucketed; joins on the text key don't move a bucketed one."""
    if store_buckets(spark, folder) is not None:
        return read_bucketed_store(spark, folder)
    return spark.read.schema(STORE_SCHEMA).parquet(folder)


def prediction_frame(
    df: DataFrame,
    class_names: Sequence[str],
    probs: str | Column = "probs",
    metadata: Sequence[str] = METADATA_COLUMNS,
    label_id: str = "label_id",
    label: str = "label",
    optional: Sequence[str] = ("original_label", "label_weight", "effective_sample_weight"),
) -> DataFrame:
    """Metadata, truth, weights, top class with confidence, and one probability column per class."""
    probs = F.col(probs) if isinstance(probs, str) else probs
    names = F.array(*[F.lit(n) for n in class_names])
    flat = probability_columns(df.sparkSession, class_names)
    top = top_class(probs)
    truth = present(df, [label_id, label, *optional])
    return df.select(
        *present(df, metadata), *truth,
        top.alias("predicted_label_id"), F.element_at(names, top + 1).alias("predicted_label"),
        confidence(probs).alias("prediction_confidence"),
        *[F.get(probs, F.lit(i)).alias(c) for i, c in enumerate(flat)],
    )


def write_predictions(df: DataFrame, folder: str) -> None:
    df.write.partitionBy("split").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def evaluation_splits(df: DataFrame, splits: Sequence[str] = ("valid", "test")) -> DataFrame:
    """Rows of the held-out splits, the ones curves are drawn for."""
    return df.where(F.col("split").isin(*splits))
