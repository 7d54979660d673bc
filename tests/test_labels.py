import pytest
from pyspark.sql import functions as F

from relvec.functions import scalars as S
from relvec.operators import labels as L
from relvec.operators import weights as W
from relvec.schema import LABEL_ORDER


def labels(spark, values):
    return spark.createDataFrame([(v,) for v in values], "label string")


def test_merging_rejects_unmapped_and_missing_labels(spark):
    assert [r[0] for r in labels(spark, ["Go", "Why not"]).select(L.merged_label("label", "merged3")).collect()] == ["Go", "Interesting / Why not"]
    for bad in ("Other", None):
        with pytest.raises(Exception, match="has no merged2 target"):
            labels(spark, ["Go", bad]).select(L.merged_label("label", "merged2")).collect()
    with pytest.raises(Exception, match="label is missing"):
        labels(spark, [None]).select(L.merged_label("label", "original")).collect()
    with pytest.raises(ValueError, match="unsupported label mode"):
        L.merged_label("label", "merged9")


def test_class_order(spark):
    df = labels(spark, ["b", "Why not", "a", "Go", None])
    assert L.class_names(L.class_list(df)) == ["Go", "Why not", "a", "b"]
    assert L.class_names(L.class_list(df, preferred=None)) == ["Go", "Why not", "a", "b"]
    assert L.class_names(L.class_list(df, preferred=["b", "zz"])) == ["b", "Go", "Why not", "a"]
    with pytest.raises(Exception, match="at least 2 labels"):
        L.class_list(labels(spark, ["Go", "Go"])).collect()


def test_encoding_rejects_unseen_labels(spark):
    classes = L.class_list(labels(spark, ["Go", "Why not"]))
    assert [r.label_id for r in L.encode_labels(labels(spark, ["Why not", "Go"]), classes).collect()] == [1, 0]
    for bad in ("new", None):
        with pytest.raises(Exception, match="not in the training split"):
            L.encode_labels(labels(spark, ["Go", bad]), classes).collect()
    unknown = L.unknown_labels(labels(spark, ["Go", "new", None]), classes).collect()
    assert {r.label for r in unknown} == {"new", None}


def test_label_names(spark):
    values = ["Interesting / Why not", "***", "  Go ", "A__b--C"]
    got = [r[0] for r in labels(spark, values).select(S.safe_label_name("label")).collect()]
    assert got == ["interesting_why_not", "label", "go", "a_b_c"]
    assert L.probability_columns(spark, ["Go", "Why not"]) == ["prob_go", "prob_why_not"]
    with pytest.raises(ValueError, match="share a column name"):
        L.probability_columns(spark, ["a b", "A-B"])


def test_published_class_weights(spark):
    """111970 / (5 * 18198) is 1.23057479, so the last weight rounds up."""
    counts = dict(zip(LABEL_ORDER, (44388, 12058, 18568, 18758, 18198)))
    pairs = spark.createDataFrame(list(counts.items()), "label string, n int")
    train = pairs.select("label", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    classes = L.class_list(train)
    table = W.class_weights(L.encode_labels(train, classes), classes)
    got = {r.label: round(r.class_weight, 6) for r in table.collect()}
    assert got == {"Go": 0.504506, "Interesting": 1.857190, "Why not": 1.206053, "Not interesting": 1.193837, "Out of scope": 1.230575}


def test_empty_class_fails(spark):
    classes = spark.createDataFrame([(0, "a"), (1, "b")], "label_id int, label string")
    with pytest.raises(Exception, match="no training rows: b"):
        W.class_weights(spark.createDataFrame([(0,)], "label_id int"), classes).collect()


def test_weights_become_positive(spark):
    values = [float("nan"), float("inf"), float("-inf"), 0.0, -1.0, 2.5]
    df = spark.createDataFrame([("train", v) for v in values], "split string, w double")
    assert [r[0] for r in df.select(S.positive_weight("w")).collect()] == [1e-6] * 5 + [2.5]
    stats = W.weight_stats(df, "w").first()
    assert (stats.weight_count, stats.replaced_non_finite, stats.replaced_non_positive) == (6, 3, 2)


def test_weight_parts_are_optional(spark):
    df = spark.createDataFrame([(0, 2.0), (1, 4.0)], "label_id int, label_weight double")
    balance = spark.createDataFrame([(0, 0.5), (1, 3.0)], "label_id int, class_weight double")
    value = lambda d: [r.effective_sample_weight for r in d.orderBy("label_id").collect()]
    assert value(W.training_weights(df, balance)) == [1.0, 12.0]
    assert value(W.training_weights(df, None)) == [2.0, 4.0]
    assert value(W.training_weights(df, balance, base=None)) == [0.5, 3.0]
    assert "effective_sample_weight" not in W.training_weights(df, None, base="absent").columns


def test_cold_start_rules(spark):
    rows = [("coldstart", "x", "TRUE"), ("ColdStart", "0", "no"), (None, "1", None), ("u", None, "1")]
    df = spark.createDataFrame(rows, "user_profile_text string, embedding_user_available string, is_coldstart string")
    cold = lambda d: [r[0] for r in d.select(S.cold_start(d)).collect()]
    assert cold(df) == [True, True, False, True]
    assert cold(df.drop("embedding_user_available")) == [True, False, False, True]
    assert cold(df.select("user_profile_text")) == [True, True, False, False]
    assert cold(df.select(F.lit(1).alias("other"))) == [False] * 4
    flag = spark.createDataFrame([(True,), (False,), (None,)], "is_coldstart boolean")
    assert cold(flag) == [True, False, False]
    assert [r[0] for r in df.select(S.user_available()).collect()] == [0, 1, 1, 1]
