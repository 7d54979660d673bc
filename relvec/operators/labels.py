"""Label modes, class lists, encoding and decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relvec.functions.scalars import safe_label_name
from relvec.schema import LABEL_ORDER, MERGED2, MERGED2_ORDER, MERGED3, MERGED3_ORDER

LABEL_MODES = {
    "original": (None, LABEL_ORDER),
    "merged3": (MERGED3, MERGED3_ORDER),
    "merged2": (MERGED2, MERGED2_ORDER),
}


def _mode(name: str):
    if name not in LABEL_MODES:
        raise ValueError(f"unsupported label mode: {name}")
    return LABEL_MODES[name]


def _or_fail(value: Column, label: Column, why: str) -> Column:
    shown = F.coalesce(label.cast("string"), F.lit("NULL"))
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"{why}: "), shown)).cast("string"))


def merged_label(label: str | Column, mode: str) -> Column:
    """Label under a mode. A label without a target, NULL included, fails the job."""
    label = (F.col(label) if isinstance(label, str) else label).cast("string")
    mapping, _ = _mode(mode)
    if mapping is None:
        return _or_fail(label, label, "label is missing")
    pairs = [F.lit(text) for pair in mapping.items() for text in pair]
    return _or_fail(F.try_element_at(F.create_map(*pairs), label), label, f"label has no {mode} target")


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))


def class_list(train: DataFrame, label: str = "label", preferred: Sequence[str] | None = LABEL_ORDER) -> DataFrame:
    """`label_id, label`: preferred labels first, the rest sorted; fewer than two classes fail the job.

    One aggregate whose state is the set of classes; NULL labels are left out.
    """
    preferred = list(preferred or [])
    found = F.array_sort(F.collect_set(F.col(label).cast("string")))
    first = F.array(*[F.lit(p) for p in preferred]) if preferred else F.array().cast("array<string>")
    ordered = F.concat(F.filter(first, lambda p: F.array_contains("found", p)), F.array_except("found", first))
    checked = F.when(F.size("classes") >= 2, F.col("classes")).otherwise(
        F.raise_error(F.concat(F.lit("expected at least 2 labels, found "), F.size("classes").cast("string")))
        .cast("array<string>")
    )
    return (
        train.agg(found.alias("found")).select(ordered.alias("classes")).select(checked.alias("classes"))
        .select(F.posexplode("classes").alias("label_id", "label"))
    )


def unknown_labels(df: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels that the class list does not hold. A NULL label is always unknown."""
    return df.select(F.col(label).cast("string").alias("label")).distinct().join(
        classes.select("label"), "label", "left_anti"
    )


def encode_labels(df: DataFrame, classes: DataFrame, label: str = "label", output: str = "label_id") -> DataFrame:
    """Add the class id; a label outside the class list fails the job."""
    table = classes.select(F.col("label").alias("_label"), F.col("label_id").alias("_id"))
    # The class table has one row per class, the fixed outcome space of the task.
    joined = df.join(F.broadcast(table), F.col(label).cast("string") == F.col("_label"), "left")
    failure = F.raise_error(
        F.concat(F.lit("label is not in the training split: "), F.coalesce(F.col(label).cast("string"), F.lit("NULL")))
    ).cast("int")
    return joined.select(*df.columns, F.coalesce(F.col("_id"), failure).alias(output))


def decode_labels(
    df: DataFrame, class_names: Sequence[str], label_id: str = "label_id", output: str = "label"
) -> DataFrame:
    names = F.array(*[F.lit(n) for n in class_names])
    return df.withColumn(output, F.element_at(names, F.col(label_id).cast("int") + 1))


def class_names(classes: DataFrame) -> list[str]:
    return [row["label"] for row in classes.orderBy("label_id").collect()]


def probability_columns(spark, names: Sequence[str]) -> list[str]:
    """`prob_<label>` per class; labels that fold to the same name are an error."""
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, label string")
    folded = [r[0] for r in rows.orderBy("i").select(safe_label_name("label")).collect()]
    if len(set(folded)) != len(folded):
        raise ValueError(f"labels share a column name: {folded}")
    return [f"prob_{n}" for n in folded]
