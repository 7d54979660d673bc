"""Left lookup joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relvec.session import materialize, shuffle_partitions

SLOTS_PER_PARTITION = 4


def hot_slots(df: DataFrame) -> int:
    """A key is hot if it holds more than a quarter of what a shuffle partition holds on average."""
    return SLOTS_PER_PARTITION * shuffle_partitions(df.sparkSession)


class Usage(NamedTuple):
    """How unevenly a lookup table is used: hot entries have a count above `limit`."""

    limit: int
    hot: int
    entries: int


def usage(table: DataFrame, count: str, by: str) -> dict[str, Usage]:
    """Measure a stored lookup table, per value of `by`, in one job over its count column.

    Hot is an entry used by more than 1/slots of all rows. The counts add up to the rows, so fewer than `slots`
    entries are hot, whatever the size of the data.
    """
    slots = hot_slots(table)
    totals = table.groupBy(by).agg(F.floor(F.sum(count) / slots).alias("limit"))
    # One row per value of `by`, a role.
    measured = table.join(F.broadcast(totals), by).groupBy(by).agg(
        F.first("limit").alias("limit"), F.count_if(F.col(count) > F.col("limit")).alias("hot"),
        F.count(F.lit(1)).alias("entries"),
    )
    return {r[by]: Usage(r["limit"], r["hot"], r["entries"]) for r in measured.collect()}


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    payload: Sequence[str],
    count: str | None = None,
    used: Usage | None = None,
    wanted: Column | None = None,
    missing: str | None = None,
) -> DataFrame:
    """Left join `payload` of `table` (unique on `key`) to `rows`.

    With `count` (how often `rows` use an entry) and its measured `used`, hot entries are joined by broadcast: their
    number is below a fixed slot count. The rows they serve, and rows for which `wanted` is false,
    take part in the shuffled join under scattered keys that match nothing, so no partition collects them. When every
    entry is hot the table itself is below the slot count and the shuffled join is left out. `missing` makes an
    unmatched wanted key an error.
    """
    payload = list(payload)
    entries = table.select(F.col(key).alias("_k"), F.struct(*payload).alias("_p"))
    want = (F.lit(True) if wanted is None else wanted) & F.col(key).isNotNull()
    out = rows.withColumn("_want", F.coalesce(want, F.lit(False)))
    found, shuffle_rest = [], True
    if used is not None:
        if used.hot:
            few = table.where(F.col(count) > used.limit).select(
                F.col(key).alias("_hk"), F.struct(*payload).alias("_hp")
            )
            out = out.join(F.broadcast(few), F.col("_want") & (F.col(key) == F.col("_hk")), "left")
            found.append(F.col("_hp"))
        shuffle_rest = used.hot < used.entries
    if shuffle_rest:
        need = F.col("_want") & F.col("_hk").isNull() if found else F.col("_want")
        probe = F.when(need, F.col(key)).otherwise(_scatter(rows, key))
        out = out.withColumn("_probe", probe).join(entries, F.col("_probe") == F.col("_k"), "left")
        found.append(F.col("_p"))
    if not found:
        found.append(F.lit(None).cast(entries.schema["_p"].dataType))
    value = F.coalesce(*found)
    if missing is not None:
        failure = F.raise_error(F.concat(F.lit(f"{missing}: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
        asked = F.lit(True) if wanted is None else wanted
        value = F.when(asked & value.isNull(), failure.cast(entries.schema["_p"].dataType)).otherwise(value)
    out = out.withColumn("_found", value)
    return out.select(*rows.columns, *[F.col(f"_found.{p}").alias(p) for p in payload])


def lookup_measured(rows: DataFrame, table: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """Left lookup whose hot keys are counted on the very rows that are joined, by one aggregate over the key."""
    counted = rows.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("_uses"))
    entries = materialize(table.join(counted, key).withColumn("_all", F.lit("all")), "counted")
    return lookup(rows, entries, key, payload, "_uses", usage(entries, "_uses", "_all").get("all"))


def _scatter(rows: DataFrame, key: str) -> Column:
    """Keys that match no entry, spread by the content of the row, so a repeated task makes the same ones."""
    short = ("int", "bigint", "tinyint", "smallint", "timestamp", "timestamp_ntz", "date", "double")
    picked = [f.name for f in rows.schema.fields if f.dataType.simpleString() in short]
    picked += [c for c in rows.columns if c.endswith(("_key", "_id")) and c not in picked]
    mixed = F.xxhash64(*[F.col(f"`{c}`") for c in picked or rows.columns[:1]])
    if rows.schema[key].dataType.simpleString() == "string":
        return F.concat(F.lit("-"), mixed.cast("string"))
    return -1 - F.shiftrightunsigned(mixed, 34)
