"""Distinct texts per role: counts, dense ids, ids on interactions, unfinished work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relvec.functions.scalars import text_key, text_or_empty
from relvec.operators.lookup import lookup, usage
from relvec.operators.ordered import dense_ids
from relvec.schema import ROLE_ID, ROLE_TEXT, ROLES, require_columns, require_unique
from relvec.session import materialize

def role_texts(interactions: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """One row per interaction and role, from a single scan. A NULL text counts as the empty text."""
    require_columns(interactions, [ROLE_TEXT[r] for r in roles], "interactions")
    pairs = F.array(
        *[F.struct(F.lit(r).alias("role"), text_or_empty(ROLE_TEXT[r]).alias("text")) for r in roles]
    )
    return interactions.select(F.inline(pairs))


def text_counts(interactions: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """How often each distinct text occurs; map-side partial counts absorb a text that fills most rows."""
    return role_texts(interactions, roles).groupBy("role", "text").agg(F.count(F.lit(1)).alias("source_count"))


def text_dictionary(interactions: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """`role, text, source_count, text_id, text_key`: ids from 0 per role, most frequent text first.

    Ties follow the hash of the text, so ids do not depend on partitioning and texts that begin alike are spread. Only
    narrow rows (role, hash, count) are numbered; texts come back by key.
    """
    counted = materialize(text_counts(interactions, roles).withColumn("text_key", text_key("text")), "texts")
    numbered = dense_ids(
        counted.drop("text"), ["role"], [F.desc("source_count"), F.asc("text_key")], "text_id",
    )
    return counted.select("role", "text", "text_key").join(numbered, ["role", "text_key"]).select(
        "role", "text", "source_count", "text_id", "text_key"
    )


def with_text_keys(interactions: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    require_columns(interactions, [ROLE_TEXT[r] for r in roles], "interactions")
    return interactions.withColumns({f"{r}_text_key": text_key(ROLE_TEXT[r]) for r in roles})


def attach_text_ids(interactions: DataFrame, dictionary: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """Add one id column per role. Joins compare 64-character keys, never the texts; a key that occurs twice is an error."""
    out = with_text_keys(interactions, roles)
    used = usage(require_unique(dictionary, ["role", "text_key"], "dictionary"), "source_count", "role")
    for role in roles:
        entries = dictionary.where(F.col("role") == role).select(
            F.col("text_key").alias(f"{role}_text_key"), F.col("text_id").alias(ROLE_ID[role]), "source_count"
        )
        out = lookup(out, entries, f"{role}_text_key", [ROLE_ID[role]], count="source_count",
                     used=used.get(role), missing=f"{role} text is not in the dictionary")
    return out.drop(*[f"{r}_text_key" for r in roles])


def pending(everything: DataFrame, done: DataFrame, keys: Sequence[str] = ("role", "text_key")) -> DataFrame:
    """Work that no earlier run has finished. Keys are text hashes, so a changed input stays safe."""
    return everything.join(done.select(*keys), list(keys), "left_anti")


def completion(everything: DataFrame, done: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Finished and total keys per group and their ratio; a group without keys is complete."""
    marked = everything.select(*dict.fromkeys([*by, *keys])).join(
        done.select(*keys).distinct().withColumn("_done", F.lit(1)), list(keys), "left"
    )
    return (
        marked.groupBy(*by)
        .agg(F.count("_done").alias("completed"), F.count(F.lit(1)).alias("total"))
        .withColumn("fraction", F.round(F.coalesce(F.try_divide("completed", "total"), F.lit(1.0)), 6))
    )
