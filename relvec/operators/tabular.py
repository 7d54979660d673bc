"""Feature selection, label/feature separation and one-hot encoding over all splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relvec.functions.scalars import time_features
from relvec.operators.lookup import lookup_measured
from relvec.operators.ordered import dense_ids
from relvec.schema import present, require_columns
from relvec.session import materialize

MISSING = "__missing__"


def metadata(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that exist."""
    return df.select(*present(df, columns))


def select_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return require_columns(df, columns, "feature table").select(*columns)


def feature_frame(
    df: DataFrame,
    target: str = "label",
    weight: str | None = "label_weight",
    drop: Sequence[str] = (),
    selected: Sequence[str] = (),
    time_column: str | None = None,
) -> DataFrame:
    """Inputs only: without target and weight, with time features, without dropped columns, then a subset."""
    out = df.drop(*[c for c in (target, weight) if c])
    if time_column:
        out = time_features(out, time_column)
    out = out.drop(*present(out, drop))
    return select_features(out, selected) if selected else out


def union_splits(frames: Mapping[str, DataFrame], tag: str = "split") -> DataFrame:
    """Stack splits whose columns may differ; absent values become NULL."""
    tagged = [frame.withColumn(tag, F.lit(name)) for name, frame in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def categorical_columns(df: DataFrame, skip: Sequence[str] = ("split",)) -> list[str]:
    kinds = (T.StringType, T.BooleanType)
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, kinds)]


def _category(df: DataFrame, column: str):
    value = F.col(column)
    if isinstance(df.schema[column].dataType, T.BooleanType):
        value = F.initcap(value.cast("string"))  # True / False, as in the column names of data frames
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct (column, value) pairs over all splits, from one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _category(df, c).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).distinct()


def one_hot(df: DataFrame, keep: Sequence[str] = ("split",), values: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Flat 0/1 columns `<column>_<value>` shared by all splits: other columns first, then sorted categories.

    A flat table has a column per category, so its categories are part of its schema. They are found by a distinct
    over all splits unless `values` lists them; `one_hot_indices` is the form whose schema doesn't grow.
    """
    names = categorical_columns(df, keep)
    if not names:
        return df
    if values is None:
        found = categories(df, names).collect()
        values = {c: [r["value"] for r in found if r["column"] == c] for c in names}
    values = {c: sorted(values.get(c, ())) for c in names}
    numeric = [c for c in df.columns if c not in names and c not in keep]
    flags = [
        F.when(_category(df, c) == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for c in names for v in values[c]
    ]
    return df.select(*present(df, keep), *[F.col(c).cast("double").alias(c) for c in numeric], *flags)


def one_hot_indices(df: DataFrame, key: Sequence[str], keep: Sequence[str] = ("split",)) -> tuple[DataFrame, DataFrame]:
    """Sparse form for any number of categories: (key, active indices) and the index table."""
    names = categorical_columns(df, keep)
    index = dense_ids(
        categories(df, names).withColumn("all", F.lit(0)), ["all"], [F.asc("column"), F.asc("value")], "index"
    ).drop("all")
    index = materialize(index, "categories")
    # One lookup per categorical column; a value that many rows hold is found before the shuffle.
    rows = df.select(*key, *[_category(df, c).alias(f"_v_{c}") for c in names])
    for c in names:
        entries = index.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("index").alias(f"_i_{c}"))
        rows = lookup_measured(rows, entries, f"_v_{c}", [f"_i_{c}"])
    active = F.array_sort(F.array(*[F.col(f"_i_{c}") for c in names]))
    return rows.select(*key, active.alias("active")), index
