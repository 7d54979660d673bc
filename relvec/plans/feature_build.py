"""From interaction splits to an embedding store and a feature table."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relvec.operators.encode import Encoder
from relvec.operators.features import cosine_features
from relvec.operators.text_dictionary import text_dictionary
from relvec.schema import parse_prefix_dims
from relvec.session import exists
from relvec.sources.records import append_run_record
from relvec.sources.bucketed import write_bucketed_store
from relvec.sources.tables import read_splits, read_store, write_features
from relvec.streaming.incremental import embed_pending


def _fingerprints(rows: DataFrame, dictionary: DataFrame, dims: Sequence[int], name: str, vectors: DataFrame) -> dict[str, str]:
    """What a split's features depend on, from counts and hashes; one row per split reaches the driver."""

    def of(df: DataFrame, *columns: str):
        row = F.xxhash64(*[F.col(c) for c in columns])
        return df, [F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s")]

    shared = []
    for frame, columns in ((dictionary, ("role", "text_key", "text_id")), (vectors, ("role", "text_key", "embedding"))):
        frame, sums = of(frame, *columns)
        shared.append([str(v) for v in frame.agg(*sums).first()])
    frame, sums = of(rows, *rows.columns)
    per_split = frame.groupBy("split").agg(*sums).orderBy("split").collect()
    return {r["split"]: json.dumps([str(r["n"]), str(r["x"]), str(r["s"]), shared, list(dims), name]) for r in per_split}


def _finished(spark: SparkSession, folder: str) -> dict[str, str]:
    return {r["split"]: r["fingerprint"] for r in spark.read.parquet(folder).collect()} if exists(spark, folder) else {}


def build(
    spark: SparkSession,
    splits_dir: str,
    output_dir: str,
    make_encoder: Callable[[], Encoder],
    full_dim: int = 1024,
    prefix_dims: str | Sequence[int] = (256, 512, 1024),
    once_per_triple: bool = True,
    name: str = "",
) -> dict:
    """Embed each distinct text once, write features per split, and record the job.

    A rerun embeds only new texts, and computes only splits whose rows, ids, vectors or prefix lengths have changed.
    """
    dims = parse_prefix_dims(prefix_dims, full_dim)
    rows = read_splits(spark, splits_dir)
    dictionary = text_dictionary(rows)
    dictionary.write.mode("overwrite").partitionBy("role").parquet(f"{output_dir}/texts")
    dictionary = spark.read.parquet(f"{output_dir}/texts")
    embedded = embed_pending(spark, dictionary, f"{output_dir}/vectors", make_encoder, full_dim)
    # Vectors are kept by text; ids and counts follow the current dictionary, so the store is joined anew. It is bucketed, so
    # the lookups of no split move it.
    vectors = read_store(spark, f"{output_dir}/vectors").select("role", "text_key", "embedding")
    write_bucketed_store(dictionary.drop("text").join(vectors, ["role", "text_key"]), f"{output_dir}/store", "overwrite")
    store = read_store(spark, f"{output_dir}/store")
    wanted = _fingerprints(rows, dictionary, dims, name, vectors)
    finished = _finished(spark, f"{output_dir}/features_done")
    todo = [s for s in wanted if finished.get(s) != wanted[s]]
    for split in todo:
        features = cosine_features(rows.where(F.col("split") == split), store, dims, name, once_per_triple)
        write_features(features, f"{output_dir}/features")
        # Written last: a split that isn't listed here is computed again.
        write_features(spark.createDataFrame([(split, wanted[split])], "split string, fingerprint string"), f"{output_dir}/features_done")
    sizes = {r["role"]: r["n"] for r in dictionary.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    record = {
        "created_at": datetime.now(timezone.utc).isoformat(),
        "splits_dir": splits_dir, "output_dir": output_dir, "dimensions": full_dim, "prefix_dims": dims,
        "text_roles": sizes, "embedded_now": embedded, "splits_now": todo,
    }
    append_run_record(spark, record, f"{output_dir}/manifest")
    return record
