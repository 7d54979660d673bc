"""Calibration bins and confidence histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relvec.operators.metrics import scored
from relvec.operators.ordered import join_by_range, running_sums
from relvec.session import materialize


def quantile_edges(points: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """Exact inner quantiles of a grouped value (`score`, `n`, `cum_n`, by range), linear between neighbours.

    The k-th edge lies at position k * (rows - 1) / bins; whole-number arithmetic finds the two ranks around it, and
    the running count finds the value at a rank. No task sees all values of a group.
    """
    totals = points.groupBy(*by).agg(F.sum("n").alias("_rows"))
    k = F.explode(F.sequence(F.lit(1), F.lit(bins - 1)))
    spots = totals.select(*by, "_rows", k.alias("_k"))
    product = F.col("_k") * (F.col("_rows") - 1)
    spots = spots.select(
        *by, "_k", F.expr(f"_k * (_rows - 1) div {bins}").alias("_low"),
        (F.pmod(product, F.lit(bins)) / F.lit(float(bins))).alias("_t"),
    )
    wanted = spots.select(*by, "_k", "_t", F.explode(F.array(F.lit(0), F.lit(1))).alias("_side"), "_low")
    wanted = wanted.withColumn("_rank", F.col("_low") + F.col("_side"))
    # One row per evaluation with its 2 * (bins - 1) ranks; a point yields rows only for ranks that fall on it.
    ranks = wanted.groupBy(*by).agg(F.collect_list(F.struct("_k", "_t", "_side", "_rank")).alias("_ranks"))
    here = F.filter("_ranks", lambda r: (r["_rank"] < F.col("cum_n")) & (r["_rank"] >= F.col("cum_n") - F.col("n")))
    hits = join_by_range(points, ranks, by).select(*by, "score", F.inline(here))
    pairs = hits.groupBy(*by, "_k", "_t").agg(
        F.max(F.when(F.col("_side") == 0, F.col("score"))).alias("_a"),
        F.max(F.when(F.col("_side") == 1, F.col("score"))).alias("_b"),
    )
    edge = F.when((F.col("_t") == 0) | F.col("_b").isNull(), F.col("_a")).otherwise(
        F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")
    )
    return pairs.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("_k"), edge.alias("edge")))), lambda s: s["edge"]).alias("edges")
    )


def calibration_bins(df: DataFrame, bins: int = 10, by: Sequence[str] = ("split",)) -> DataFrame:
    """Mean confidence and accuracy per quantile bin of the confidence; bins are closed on the right.

    Rows are first grouped by distinct confidence, so ranks, bins and means all work on that smaller table.
    """
    by = list(by)
    points = scored(df).groupBy(*by, F.col("confidence").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits")
    )
    points = materialize(points, "confidences")
    ordered = running_sums(points, by, "score", ["n"], descending=False, stored=True, keep_range=True)
    binned = join_by_range(ordered, quantile_edges(ordered, by, bins), by).withColumn(
        "bin", F.size(F.filter("edges", lambda e: e < F.col("score")))
    )
    return binned.groupBy(*by, "bin").agg(
        F.sum("n").alias("n"),
        F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 6).alias("mean_confidence"),
        F.round(F.sum("hits") / F.sum("n"), 6).alias("accuracy"),
    )


def confidence_histogram(df: DataFrame, bins: int = 40, by: Sequence[str] = ("split",)) -> DataFrame:
    """Counts per equal-width bin for correct and wrong rows, each series over its own range.

    A series with one value is widened by half a unit on both sides. Values are moved to the bin whose edges enclose
    them, so a rounding error in the division cannot misplace a value that equals an edge.
    """
    keys = [*by, "correct"]
    rows = scored(df).select(*by, F.col("hit").alias("correct"), "confidence")
    flat = F.min("confidence") == F.max("confidence")
    ranges = rows.groupBy(*keys).agg(
        (F.min("confidence") - F.when(flat, 0.5).otherwise(0.0)).alias("low"),
        (F.max("confidence") + F.when(flat, 0.5).otherwise(0.0)).alias("high"),
    )
    x, low, high = F.col("confidence"), F.col("low"), F.col("high")
    step = (high - low) / bins

    def edge(i):
        return F.when(i == bins, high).otherwise(low + i.cast("double") * step)

    guess = F.least(F.floor((x - low) / (high - low) * bins).cast("int"), F.lit(bins - 1))
    placed = rows.join(ranges, keys).withColumn("_g", guess)
    moved = F.when(x < edge(F.col("_g")), F.col("_g") - 1).when(
        (x >= edge(F.col("_g") + 1)) & (F.col("_g") < bins - 1), F.col("_g") + 1
    ).otherwise(F.col("_g"))
    counted = placed.groupBy(*keys, "low", "high", moved.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        *keys, "bin", "n", F.round(edge(F.col("bin")), 6).alias("left_edge"), F.round(edge(F.col("bin") + 1), 6).alias("right_edge")
    )
