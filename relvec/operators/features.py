"""Vectors and cosine features on interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relvec.functions import vectors as V
from relvec.functions.scalars import cold_start, is_cold_text, user_available
from relvec.operators.lookup import Usage, lookup, usage
from relvec.operators.text_dictionary import with_text_keys
from relvec.schema import COLD_START_TEXT, ROLE_ID, ROLES, require_columns, require_unique
from relvec.session import materialize

VECTOR = {role: f"{role}_vec" for role in ROLES}


def _role_entries(store: DataFrame, role: str, key: str, key_name: str) -> DataFrame:
    return store.where(F.col("role") == role).select(
        F.col(key).alias(key_name),
        *[F.col("text_id").alias(ROLE_ID[role])] * (key != "text_id"),
        F.col("embedding").alias(VECTOR[role]),
        "source_count",
    )


def _largest_first(used: dict[str, Usage]) -> list[str]:
    """Roles that need a shuffle come first, so vectors of small, broadcast roles never travel through one."""
    return sorted(ROLES, key=lambda role: -used[role].entries if role in used else 0)


def attach_vectors(rows: DataFrame, store: DataFrame, skip_user=None) -> DataFrame:
    """Gather the three vectors of rows that carry text ids; an id without a vector fails the job.

    Where `skip_user` is true no user vector is looked up, so the one text shared by all cold rows is no join key.
    """
    require_columns(rows, ROLE_ID.values(), "rows")
    used = store_usage(store, "text_id")
    for role in _largest_first(used):
        wanted = ~skip_user if role == "user" and skip_user is not None else None
        entries = _role_entries(store, role, "text_id", ROLE_ID[role])
        rows = lookup(rows, entries, ROLE_ID[role], [VECTOR[role]], count="source_count",
                      used=used.get(role), wanted=wanted, missing=f"no {role} vector for text id")
    return rows


def store_usage(store: DataFrame, key: str = "text_key") -> dict[str, Usage]:
    """How evenly the store is used. A key that occurs twice would multiply rows, so it is an error."""
    return usage(require_unique(store, ["role", key], "store"), "source_count", "role")


def attach_ids_and_vectors(rows: DataFrame, store: DataFrame, used: dict[str, Usage] | None = None) -> DataFrame:
    """Ids and vectors in one join per role, for rows that carry text keys. `used` must describe this very store."""
    used = store_usage(store) if used is None else used
    for role in _largest_first(used):
        key = f"{role}_text_key"
        entries = _role_entries(store, role, "text_key", key)
        rows = lookup(rows, entries, key, [ROLE_ID[role], VECTOR[role]], count="source_count",
                      used=used.get(role), missing=f"{role} text is not in the store").drop(key)
    return rows


def add_cosines(rows: DataFrame, dims: Sequence[int], name: str = "", cold=None, arrow: bool = True) -> DataFrame:
    """Replace the vectors by the availability flag and four cosines per prefix length."""
    cold = is_cold_text() if cold is None else cold
    sums = (V.prefix_sums if arrow else V.prefix_sums_builtin)(*(F.col(VECTOR[r]) for r in ROLES), dims)
    kept = [c for c in rows.columns if c not in VECTOR.values()]
    with_sums = rows.select(
        *kept, cold.alias("_cold"), F.when(cold, 0).otherwise(1).cast("tinyint").alias("embedding_user_available"),
        sums.alias("_sums"),
    )
    return with_sums.select(
        *kept, "embedding_user_available", *V.cosine_columns("_sums", dims, F.col("_cold"), name)
    )


def cosine_features(
    interactions: DataFrame,
    store: DataFrame,
    dims: Sequence[int],
    name: str = "",
    once_per_triple: bool = False,
    arrow: bool = True,
    used: dict[str, Usage] | None = None,
) -> DataFrame:
    """Interactions with text ids, availability flag and cosines; every input column passes through but for text keys, which
    are computed where they are missing.

    With `once_per_triple` each distinct (query, user, candidate) is computed once: only text hashes travel through the
    three lookups, copies are absorbed by the first partial count, and the wide rows are shuffled once, when the stored
    features come back. It needs no row id. Choose it when rows are wide or repeat.
    """
    named = {f"{role}_text_key" for role in ROLES} <= set(interactions.columns)
    keyed = interactions if named else with_text_keys(interactions)
    cold = F.col("user_text_key") == F.sha2(F.lit(COLD_START_TEXT), 256)
    if not once_per_triple:
        rows = attach_ids_and_vectors(keyed.withColumn("_is_cold", cold), store, used)
        return add_cosines(rows, dims, name, cold=F.col("_is_cold"), arrow=arrow).drop("_is_cold")
    keys = [f"{role}_text_key" for role in ROLES]
    triple = F.sha2(F.concat(*keys), 256)
    distinct = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumns(
        {"_triple": triple, "_is_cold": cold}
    )
    rows = attach_ids_and_vectors(distinct, store, used)
    features = materialize(add_cosines(rows, dims, name, cold=F.col("_is_cold"), arrow=arrow).drop("_is_cold"), "triples")
    payload = [*[c for c in ROLE_ID.values()], *[c for c in features.columns if c not in ("_triple", "_n", *ROLE_ID.values())]]
    measured = usage(features.withColumn("_all", F.lit("all")), "_n", "_all").get("all")
    back = keyed.withColumn("_triple", triple).drop(*keys)
    return lookup(back, features, "_triple", payload, "_n", measured, missing="no features for").drop("_triple")


def feature_vector(
    rows: DataFrame, dim: int, zero_cold_users: bool = True, output: str = "features_int8"
) -> DataFrame:
    """Concatenate the query, user and candidate prefixes; cold users are zeroed unless asked otherwise."""
    if dim <= 0:
        raise ValueError(f"prefix length must be positive, got {dim}")
    q, u, c = (V.checked_prefix(F.col(VECTOR[r]), dim) for r in ROLES)
    if zero_cold_users:
        u = V.zero_when(cold_start(rows), u, dim)
    return rows.withColumn(output, F.concat(q, u, c)).drop(*VECTOR.values())


def audit_counts(rows: DataFrame) -> DataFrame:
    """Rows and cold rows per split."""
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(user_available() == 0).alias("cold_rows"),
    )
