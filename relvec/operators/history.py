"""Training histories, early stopping, checkpoints and run ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SELECTION_METRICS = ("f1_macro", "balanced_accuracy", "accuracy", "neg_logloss")


def selection_score(metric: str, prefix: str = "") -> Column:
    """Larger is better; an undefined metric ranks below all others."""
    if metric not in SELECTION_METRICS:
        raise ValueError(f"unsupported selection metric: {metric}")
    value = -F.col(f"{prefix}logloss") if metric == "neg_logloss" else F.col(f"{prefix}{metric}")
    value = value.cast("double")
    return F.when(value.isNull() | F.isnan(value), float("-inf")).otherwise(value)


def early_stopping(
    history: DataFrame, score: str = "score", patience: int = 6, run: Sequence[str] = ("run",), epoch: str = "epoch"
) -> DataFrame:
    """Mark improvements, epochs since the last one, the best score so far, and whether the epoch would have run.

    Only a strictly better score counts. Training stops after the epoch at which `patience` epochs have passed
    without improvement. Counting from the history keeps patience across restarts.
    """
    order = W.partitionBy(*run).orderBy(epoch)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    low = F.lit(float("-inf"))
    step1 = history.withColumns({
        "_n": F.row_number().over(order),
        "improved": F.col(score) > F.coalesce(F.max(score).over(before), low),
        "best_so_far": F.max(score).over(upto),
    })
    step2 = step1.withColumn("_last", F.coalesce(F.max(F.when(F.col("improved"), F.col("_n"))).over(upto), F.lit(0)))
    step3 = step2.withColumns({
        "since_improvement": F.col("_n") - F.col("_last"),
        "best_epoch": F.max(F.when(F.col("improved"), F.col(epoch))).over(upto),
    })
    stopped = F.coalesce(F.max(F.col("since_improvement") >= patience).over(before), F.lit(False))
    return step3.withColumn("ran", ~stopped).drop("_n", "_last")


def merge_histories(old: DataFrame, new: DataFrame, series: Sequence[str], round_col: str = "round") -> DataFrame:
    """New rounds follow the last old round of the same series."""
    last = old.groupBy(*series).agg(F.max(round_col).alias("_last"))
    shifted = new.join(last, list(series), "left").withColumn(
        round_col, F.col(round_col) + F.coalesce("_last", F.lit(0))
    ).drop("_last")
    return old.unionByName(shifted.select(*old.columns))


def latest_checkpoint(names: DataFrame, name: str = "name", by: Sequence[str] = ()) -> DataFrame:
    """Checkpoint with the highest number in its name (100 follows 50)."""
    number = F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("bigint")
    return names.groupBy(*by).agg(F.max_by(name, number).alias("latest"), F.max(number).alias("number"))


RANKING = ("valid_f1_macro", "valid_balanced_accuracy", "valid_accuracy")


def rank_runs(runs: DataFrame, metrics: Sequence[str] = RANKING, tie_break: str = "experiment_name") -> DataFrame:
    """Best run first; runs without a metric come last, equal runs follow their name."""
    order = [F.col(m).cast("double").desc_nulls_last() for m in metrics]
    return runs.orderBy(*order, F.asc(tie_break))


def best_run(runs: DataFrame) -> DataFrame:
    return rank_runs(runs).limit(1)
