"""Captured embedding responses: JSON lines of base64 int8 vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relvec.functions.vectors import bytes_to_vector

RESPONSE_SCHEMA = "batch bigint, data array<struct<index:int, embedding:string>>"


def decode_base64(encoded, dim: int):
    """Base64 text to int8 vector; another length fails the job before bytes reach Python."""
    raw = F.unbase64(encoded)
    size = F.octet_length(raw)
    failure = F.raise_error(
        F.concat(F.lit(f"expected {dim} dimensions, got "), size.cast("string"))
    ).cast("binary")
    return bytes_to_vector(F.when(size == dim, raw).otherwise(failure))


def encode_base64(vector):
    """Int8 vector to base64, for recording responses."""
    pairs = F.transform(vector, lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(256)).cast("bigint")), 2, "0"))
    return F.base64(F.unhex(F.array_join(pairs, "")))


def read_responses(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(batch, index, embedding) from response lines.

    Vectors are placed by their `index`, not by their position in the line, so no sort is needed.
    """
    lines = spark.read.schema(RESPONSE_SCHEMA).json(path)
    items = lines.select("batch", F.inline("data"))
    return items.select("batch", "index", decode_base64(F.col("embedding"), dim).alias("embedding"))
