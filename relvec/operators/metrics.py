"""Multiclass metrics from two aggregates: confusion cells and grouped scores.

`by` names the columns that separate evaluations (a split, or a run and a split). Inputs carry `label_id` and
`probs array<double>`; an optional weight column counts rows by weight.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relvec.functions.probabilities import confidence, nll, top_class
from relvec.functions.scalars import rounded
from relvec.operators.ordered import join_by_range, running_sums
from relvec.schema import FLOAT32_EPS, MIN_WEIGHT

METRICS = (
    "count", "num_classes", "logloss", "accuracy", "balanced_accuracy", "precision_macro", "recall_macro",
    "f1_macro", "f1_weighted", "roc_auc_ovr_macro", "pr_auc_ovr_macro",
)


def _weight(weight: str | None) -> Column:
    return F.lit(1) if weight is None else F.col(weight).cast("double")


def scored(df: DataFrame) -> DataFrame:
    """Add predicted class, confidence and hit."""
    return df.withColumns({"predicted_id": top_class("probs"), "confidence": confidence("probs")}).withColumn(
        "hit", F.col("predicted_id") == F.col("label_id")
    )


def confusion_cells(df: DataFrame, by: Sequence[str] = ("split",), weight: str | None = None) -> DataFrame:
    """Non-empty cells with their weight, row count and summed log loss: all a threshold-free metric needs."""
    w = _weight(weight)
    rows = df.select(
        *by, "label_id", top_class("probs").alias("predicted_id"), w.alias("_w"),
        nll("probs", "label_id", FLOAT32_EPS).alias("_loss"),
    )
    return rows.groupBy(*by, "label_id", "predicted_id").agg(
        F.sum("_w").alias("n"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("_w") * F.col("_loss")).alias("loss")
    )


def confusion_matrix(
    df: DataFrame, num_classes: int, by: Sequence[str] = ("split",), weight: str | None = None
) -> DataFrame:
    """Every cell of the class grid, empty ones as 0. The cells of one evaluation are at most classes squared."""
    cells = confusion_cells(df, by, weight)
    found = F.map_from_entries(F.collect_list(F.struct(F.struct("label_id", "predicted_id").alias("k"), F.col("n").alias("v"))))
    grid = F.sequence(F.lit(0), F.lit(num_classes - 1))
    spread = cells.withColumn("label_id", F.col("label_id").cast("int")).groupBy(*by).agg(found.alias("_cells")).withColumn(
        "label_id", F.explode(grid)
    ).withColumn("predicted_id", F.explode(grid))
    n = F.coalesce(F.try_element_at("_cells", F.struct("label_id", "predicted_id")), F.lit(0))
    return spread.select(*by, "label_id", "predicted_id", n.alias("n"))


def class_scores(cells: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Per class: hits, support, predictions, precision, recall, F1, and rows and loss of its true members.

    Only classes seen on either side appear.
    """
    n = F.col("n").cast("double")
    hit = F.when(F.col("label_id") == F.col("predicted_id"), n).otherwise(0.0)
    none = F.lit(0.0)
    sides = F.array(
        F.struct(F.col("label_id").cast("int").alias("class_id"), hit.alias("tp"), n.alias("support"), none.alias("predicted"),
                 F.col("rows").alias("rows"), F.col("loss").alias("loss")),
        F.struct(F.col("predicted_id").cast("int").alias("class_id"), none.alias("tp"), none.alias("support"), n.alias("predicted"),
                 F.lit(0).cast("bigint").alias("rows"), none.alias("loss")),
    )
    summed = cells.select(*by, F.inline(sides)).groupBy(*by, "class_id").agg(
        *[F.sum(c).alias(c) for c in ("tp", "support", "predicted", "rows", "loss")]
    )
    return summed.withColumns({
        "precision": F.coalesce(F.try_divide("tp", "predicted"), none),
        "recall": F.coalesce(F.try_divide("tp", "support"), none),
        "f1": F.coalesce(F.try_divide(F.col("tp") * 2, F.col("support") + F.col("predicted")), none),
    })


def threshold_free_metrics(cells: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """One row per evaluation: row count, log loss, accuracy and the macro and weighted averages."""
    return class_scores(cells, by).groupBy(*by).agg(
        F.sum("rows").alias("count"),
        F.try_divide(F.sum("loss"), F.sum("support")).alias("logloss"),
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("f1_weighted"),
    )


def score_points(
    df: DataFrame, num_classes: int, by: Sequence[str] = ("split",), weight: str | None = None, micro: bool = False
) -> DataFrame:
    """Positive and negative weight per (evaluation, class, distinct score), one-vs-rest.

    Two classes are one problem: only the positive class is ranked. `micro` drops the class from the key.
    """
    w = _weight(weight)
    exploded = df.select(*by, "label_id", w.alias("_w"), F.posexplode("probs").alias("class_id", "score"))
    if num_classes == 2:
        exploded = exploded.where(F.col("class_id") == 1)
    positive = F.col("class_id") == F.col("label_id")
    keys = [*by] if micro else [*by, "class_id"]
    return exploded.groupBy(*keys, "score").agg(
        F.sum(F.when(positive, F.col("_w")).otherwise(0)).alias("pos"),
        F.sum(F.when(positive, 0).otherwise(F.col("_w"))).alias("neg"),
    )


def cumulative_hits(points: DataFrame, group: Sequence[str], keep_range: bool = False) -> DataFrame:
    """Running positives and negatives at or above each score."""
    return running_sums(points, group, "score", ["pos", "neg"], keep_range=keep_range)


def areas(cumulative: DataFrame, group: Sequence[str]) -> DataFrame:
    """ROC area (ties count half) and average precision per group; undefined areas are NULL."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    above = F.col("cum_pos") - pos
    step = pos * F.coalesce(F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")), F.lit(0.0))
    sums = cumulative.groupBy(*group).agg(
        F.sum(pos).alias("_p"), F.sum(neg).alias("_n"), F.sum(neg * (above + pos / 2)).alias("_u"), F.sum(step).alias("_s")
    )
    return sums.select(
        *group, F.col("_p").alias("positives"), F.col("_n").alias("negatives"),
        F.try_divide("_u", F.col("_p") * F.col("_n")).alias("roc_auc"),
        F.coalesce(F.try_divide("_s", "_p"), F.lit(0.0)).alias("average_precision"),
    )


def macro_areas(
    df: DataFrame, num_classes: int, by: Sequence[str] = ("split",), weight: str | None = None
) -> DataFrame:
    """Macro one-vs-rest ROC area (NULL when a class lacks positives or negatives) and average precision."""
    group = [*by, "class_id"]
    per_class = areas(cumulative_hits(score_points(df, num_classes, by, weight), group), group)
    all_defined = F.count("roc_auc") == F.count(F.lit(1))
    return per_class.groupBy(*by).agg(
        F.when(all_defined, F.avg("roc_auc")).alias("roc_auc_ovr_macro"),
        F.avg("average_precision").alias("pr_auc_ovr_macro"),
    )


def evaluate_wide(
    df: DataFrame, num_classes: int, by: Sequence[str] = ("split",), weight: str | None = None, ranked: bool = True
) -> DataFrame:
    """One row per evaluation with every metric rounded to 6 digits. `ranked=False` leaves the two areas NULL."""
    if not by:
        raise ValueError("name at least one column that separates evaluations")
    wide = threshold_free_metrics(confusion_cells(df, by, weight), by)
    if ranked:
        wide = wide.join(macro_areas(df, num_classes, by, weight), list(by), "left")
    else:
        wide = wide.withColumns({m: F.lit(None).cast("double") for m in METRICS[-2:]})
    return wide.select(
        *by, F.col("count").cast("long").alias("count"), F.lit(num_classes).alias("num_classes"),
        *[rounded(F.col(m)).alias(m) for m in METRICS[2:]],
    )


def to_tall(wide: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    names = [c for c in wide.columns if c not in by]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])
    return wide.select(*by, F.inline(rows))


def evaluate_split(
    df: DataFrame, num_classes: int, by: Sequence[str] = ("split",), weight: str | None = None
) -> DataFrame:
    """Tall metrics: (split, metric, value)."""
    return to_tall(evaluate_wide(df, num_classes, by, weight), by)


def to_wide(tall: DataFrame, by: Sequence[str] = ("split",), names: Sequence[str] = METRICS) -> DataFrame:
    return tall.groupBy(*by).pivot("metric", list(names)).agg(F.first("value"))


def weighted_cross_entropy(df: DataFrame, by: Sequence[str] = ("split",), weight: str | None = None) -> DataFrame:
    """Mean loss of the true class, by weights of at least 1e-6 when given."""
    w = F.lit(1.0) if weight is None else F.greatest(F.col(weight).cast("double"), F.lit(MIN_WEIGHT))
    loss = nll("probs", "label_id", 0.0)
    return df.select(*by, w.alias("_w"), loss.alias("_l")).groupBy(*by).agg(
        rounded(F.sum(F.col("_w") * F.col("_l")) / F.sum("_w")).alias("cross_entropy")
    )


def roc_curve_micro(df: DataFrame, num_classes: int, by: Sequence[str] = ("split",)) -> DataFrame:
    """Curve points over all (row, class) pairs, from the origin to (1, 1), with the area."""
    points = cumulative_hits(score_points(df, num_classes, by, micro=True), by, keep_range=True)
    totals = areas(points, by)
    zero = F.lit(0).cast(points.schema["cum_pos"].dataType)
    origin = totals.select(*by, F.lit(None).cast("double").alias("score"), zero.alias("cum_pos"), zero.alias("cum_neg"))
    known = ["score", "cum_pos", "cum_neg", "positives", "negatives", "roc_auc"]
    curve = join_by_range(points, totals, by).select(*by, *known).unionByName(origin.join(totals, list(by)).select(*by, *known))
    return curve.select(
        *by, rounded(F.col("score")).alias("threshold"),
        rounded(F.try_divide("cum_neg", "negatives")).alias("fpr"), rounded(F.try_divide("cum_pos", "positives")).alias("tpr"),
        rounded(F.col("roc_auc")).alias("auc"),
    )


def pr_curve_micro(df: DataFrame, num_classes: int, by: Sequence[str] = ("split",)) -> DataFrame:
    """Precision and recall at each distinct score, closed by (precision 1, recall 0), with average precision."""
    points = cumulative_hits(score_points(df, num_classes, by, micro=True), by, keep_range=True)
    totals = areas(points, by)
    one = F.lit(1.0)
    body = join_by_range(points, totals, by).select(
        *by, rounded(F.col("score")).alias("threshold"),
        F.coalesce(F.try_divide("cum_pos", F.col("cum_pos") + F.col("cum_neg")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("cum_pos", "positives"), one).alias("recall"), "average_precision",
    )
    last = totals.select(*by, F.lit(None).cast("double").alias("threshold"), one.alias("precision"),
                         F.lit(0.0).alias("recall"), "average_precision")
    return body.unionByName(last).select(
        *by, "threshold", *[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "average_precision")]
    )


def metric_union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
