"""Column names, fixed values and the checks that run before a plan is built."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed names: files and results carry them.
SPLITS = ("train", "valid", "test")

# role -> text column and id column of an interaction
ROLE_TEXT = {"query": "query_text", "user": "user_profile_text", "candidate": "candidate_text"}
ROLE_ID = {"query": "query_text_id", "user": "user_text_id", "candidate": "candidate_text_id"}
ROLES = tuple(ROLE_TEXT)

METADATA_COLUMNS = ("event_id", "user_id", "search_id", "profil_id", "split")

# They must equal the published defaults for results to agree.
COLD_START_TEXT = "coldstart"
MIN_WEIGHT = 1e-6
INT8_SCALE = 127.0
FLOAT32_EPS = 1.1920929e-07
LABEL_ORDER = ("Go", "Interesting", "Why not", "Not interesting", "Out of scope")
MERGED3 = {
    "Go": "Go",
    "Interesting": "Interesting / Why not",
    "Why not": "Interesting / Why not",
    "Not interesting": "Not interesting / Out of scope",
    "Out of scope": "Not interesting / Out of scope",
}
MERGED2 = {
    "Go": "Go / Interesting / Why not / Not interesting",
    "Interesting": "Go / Interesting / Why not / Not interesting",
    "Why not": "Go / Interesting / Why not / Not interesting",
    "Not interesting": "Go / Interesting / Why not / Not interesting",
    "Out of scope": "Out of scope",
}
MERGED3_ORDER = ("Go", "Interesting / Why not", "Not interesting / Out of scope")
MERGED2_ORDER = ("Go / Interesting / Why not / Not interesting", "Out of scope")

VECTOR_TYPE = T.ArrayType(T.ByteType())

STORE_SCHEMA = T.StructType(
    [
        T.StructField("text_id", T.LongType()),
        T.StructField("text_key", T.StringType()),
        T.StructField("source_count", T.LongType()),
        T.StructField("embedding", VECTOR_TYPE),
        T.StructField("role", T.StringType()),
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")
    return df


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def parse_prefix_dims(dims: str | Iterable[int], full_dim: int) -> list[int]:
    """Sorted distinct prefix lengths; the full length always closes the list."""
    if isinstance(dims, str):
        dims = [int(part) for part in dims.split(",") if part.strip()]
    chosen = set()
    for dim in dims:
        if not 1 <= dim <= full_dim:
            raise ValueError(f"prefix length {dim} is outside 1..{full_dim}")
        chosen.add(dim)
    return sorted(chosen | {full_dim})


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (empty when a lookup table is sound)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "lookup table") -> DataFrame:
    bad = duplicate_keys(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"{what} repeats keys: {[tuple(row[k] for k in keys) for row in bad]}")
    return df


def require_length(vector, dim: int):
    """Column expression that fails the job on a vector of another length."""
    return F.when(F.size(vector) == dim, vector).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vector).cast("string"))).cast(VECTOR_TYPE)
    )
