"""Text encoders: a pluggable batch backend run inside Arrow tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relvec.functions.vectors import quantize
from relvec.operators.text_dictionary import pending
from relvec.schema import STORE_SCHEMA
from relvec.session import shuffle_partitions


class Encoder(Protocol):
    """Turns a batch of texts into a matrix with one row per text."""

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEncoder:
    """Reproducible stand-in for a model, for tests of the protocol; the numbers are those of `vectors.hashed`."""

    def __init__(self, dim: int):
        self.dim = dim

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        blocks = range(-(-self.dim // 32))
        joined = b"".join(hashlib.sha256(f"{t}:{b}".encode()).digest() for t in texts for b in blocks)
        unsigned = np.frombuffer(joined, np.uint8).reshape(len(texts), -1)[:, : self.dim]
        return (unsigned.astype(np.int16) - 128).astype(np.int8)


def checked(matrix: np.ndarray, rows: int, dim: int) -> np.ndarray:
    """The encoder's matrix as doubles, if it has the right shape; how doubles become bytes is one rule, in Spark."""
    matrix = np.asarray(matrix)
    if matrix.shape != (rows, dim):
        raise ValueError(f"encoder returned shape {matrix.shape}, expected {(rows, dim)}")
    return matrix.astype(np.float64)


def encode_texts(
    texts: DataFrame, make_encoder: Callable[[], Encoder], dim: int, batch_size: int = 64
) -> DataFrame:
    """Add `embedding` to a table with a `text` column; the encoder is built once per task.

    What the encoder returns is rounded to whole numbers and clipped to a signed byte.
    """
    out_schema = T.StructType([*texts.drop("text").schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                piece = batch.slice(start, batch_size)
                values = piece.column(piece.schema.get_field_index("text")).to_pylist()
                vectors = checked(encoder.encode(values), len(values), dim)
                offsets = pa.array(np.arange(0, (len(values) + 1) * dim, dim, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))
                names = [n for n in piece.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(piece.schema.get_field_index(n)) for n in names] + [lists], names + ["embedding"]
                )

    return texts.mapInArrow(run, out_schema).withColumn("embedding", quantize("embedding"))


def encode_dictionary(
    dictionary: DataFrame,
    make_encoder: Callable[[], Encoder],
    dim: int,
    done: DataFrame | None = None,
    batch_size: int = 64,
) -> DataFrame:
    """Store rows for every dictionary text that `done` does not hold yet."""
    todo = dictionary if done is None else pending(dictionary, done)
    columns = ["role", "text_id", "text_key", "source_count", "text"]
    # Dictionary files are range-sorted by count; spread the encoder's work evenly again. A fixed number of partitions
    # keeps small rows with costly encoding from being merged into few tasks.
    spread = todo.select(*columns).repartition(shuffle_partitions(todo.sparkSession), "role", "text_key")
    return encode_texts(spread, make_encoder, dim, batch_size).select(*STORE_SCHEMA.names)
