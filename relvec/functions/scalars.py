"""Text, label, weight and time expressions on plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relvec.schema import COLD_START_TEXT, MIN_WEIGHT
from relvec.session import require_utc


def text_or_empty(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def text_key(column: str | Column) -> Column:
    """Fixed-length join key of a text, so that joins never shuffle the text itself."""
    return F.sha2(text_or_empty(column), 256)


def is_cold_text(column: str | Column = "user_profile_text") -> Column:
    """Exact, case-sensitive match."""
    return text_or_empty(column) == COLD_START_TEXT


def user_available(column: str | Column = "user_profile_text") -> Column:
    return F.when(is_cold_text(column), 0).otherwise(1).cast("tinyint")


def cold_start(df: DataFrame) -> Column:
    """Cold-start test for training. The columns present in `df` choose the rule, not the values of a row."""
    if "embedding_user_available" in df.columns:
        value = F.col("embedding_user_available")
        if not isinstance(df.schema["embedding_user_available"].dataType, T.BooleanType):
            value = value.try_cast("double")
        value = F.coalesce(value.cast("double"), F.lit(0.0))
        return F.when(F.isnan(value), True).otherwise(value <= 0)
    if "is_coldstart" in df.columns:
        value = F.col("is_coldstart")
        if isinstance(df.schema["is_coldstart"].dataType, T.BooleanType):
            return F.coalesce(value, F.lit(False))
        return F.coalesce(F.lower(value.cast("string")).isin("1", "true", "yes"), F.lit(False))
    if "user_profile_text" in df.columns:
        return F.coalesce(F.lower("user_profile_text") == COLD_START_TEXT, F.lit(False))
    return F.lit(False)


def safe_label_name(label: str | Column) -> Column:
    """Lower-case label with every other run of characters folded to one underscore."""
    label = F.col(label) if isinstance(label, str) else label
    folded = F.regexp_replace(F.lower(F.trim(label)), "[^0-9a-z]+", "_")
    stripped = F.regexp_replace(folded, "^_+|_+$", "")
    return F.when(stripped == "", "label").otherwise(stripped)


def is_non_finite(weight: Column) -> Column:
    return weight.isNull() | F.isnan(weight) | weight.isin(float("inf"), float("-inf"))


def positive_weight(weight: str | Column, floor: float = MIN_WEIGHT) -> Column:
    """Weights that are missing, NaN, infinite or not above zero become `floor`."""
    weight = (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    return F.when(is_non_finite(weight), floor).when(weight <= 0, floor).otherwise(weight)


def combined_weight(*parts: Column | None) -> Column | None:
    """Product of the parts that are given."""
    product = None
    for part in parts:
        if part is not None:
            product = part if product is None else product * part
    return product


def rounded(value: Column, digits: int = 6) -> Column:
    """Metric rounding; a value that is not a number is undefined, hence NULL."""
    return F.round(F.nanvl(value, F.lit(None).cast("double")), digits)


def time_features(df: DataFrame, column: str) -> DataFrame:
    """Replace a time column by calendar features in UTC; values that are no time become NULL.

    Monday is weekday 0. The weekend flag of an unreadable time is 0. Without the column this is a no-op.
    """
    if column not in df.columns:
        return df
    require_utc(df.sparkSession)
    ts = F.col(column).try_cast("timestamp")
    weekday = F.weekday(ts)
    features = {
        "hour": F.hour(ts).cast("double"),
        "dayofweek": weekday.cast("double"),
        "day": F.day(ts).cast("double"),
        "month": F.month(ts).cast("double"),
        "is_weekend": F.when(weekday.isin(5, 6), 1.0).otherwise(0.0),
        "epoch_seconds": F.unix_micros(ts) / F.lit(1e6),
    }
    kept = [F.col(c) for c in df.columns if c != column]
    return df.select(*kept, *[expr.alias(f"{column}_{name}") for name, expr in features.items()])
