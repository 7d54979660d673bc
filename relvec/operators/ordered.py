"""Ordered operators without a task that sees a whole group.

`dense_ids` numbers the rows of a group in order; `running_sums` accumulates over ordered scores. Both split a group
into ranges, work inside each range, and add the totals of the earlier ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relvec.session import materialize, shuffle_partitions

_ROWS_PER_PARTITION_BITS = 33  # layout of monotonically_increasing_id


def dense_ids(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], id_column: str
) -> DataFrame:
    """Zero-based position of each row inside its group. `group` + `order` must identify a row and should be short:
    range bounds are sampled keys that reach the driver.
    """
    keys = [F.col(g) for g in group] + list(order)
    parts = shuffle_partitions(df.sparkSession)
    placed = (
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # Range bounds are sampled anew in every job, so positions must be fixed once.
    placed = materialize(placed, "ordered").withColumn("_range", F.shiftright("_at", _ROWS_PER_PARTITION_BITS))
    ranges = placed.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select(
        *group, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    joined = placed.join(offsets, [*group, "_range"])
    return joined.select(
        *[c for c in df.columns if c != id_column], (F.col("_at") + F.col("_shift")).alias(id_column)
    )


ROWS_PER_WINDOW = 1_000_000  # rows one window task is meant to sort


def running_sums(
    points: DataFrame,
    group: Sequence[str],
    score: str,
    values: Sequence[str],
    descending: bool = True,
    rows_per_window: int = ROWS_PER_WINDOW,
    stored: bool = False,
    keep_range: bool = False,
) -> DataFrame:
    """Add `cum_<value>` per group in score order. `points` holds each (group, score) once.

    The points are stored first, unless the caller did, and then stored again by range of (group, score); their number decides how
    many ranges there are, so that no window sorts much more than `rows_per_window` rows. Any bounds give the same sums, and
    the plan doesn't grow with their number. `keep_range` keeps the number of a point's range, for `join_by_range`.
    """
    group = list(group)
    points = points if stored else materialize(points, "points")
    order = F.desc(score) if descending else F.asc(score)
    parts = points.count() // rows_per_window + 1
    # Bounds are sampled anew in every job, so ranges must be fixed once.
    placed = materialize(points.repartitionByRange(parts, *group, order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = W.partitionBy(*group, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = placed.select("*", *[F.sum(v).over(inside).alias(f"cum_{v}") for v in values])
    totals = placed.groupBy(*group, "_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *group, "_range", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    joined = local.join(offsets, [*group, "_range"])
    return joined.select(
        *points.columns, *["_range"] * keep_range, *[(F.col(f"cum_{v}") + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values]
    )


def join_by_range(points: DataFrame, per_group: DataFrame, group: Sequence[str]) -> DataFrame:
    """Bring the one row of each group to its points (of `running_sums` with `keep_range`), range by range, so a group that
    holds all points is no join key of all points."""
    ranges = points.select(*group, "_range").distinct().join(per_group, list(group))
    return points.join(ranges, [*group, "_range"])
