import pytest
from pyspark.sql import functions as F

from relvec.functions.scalars import time_features
from relvec.operators import history as H
from relvec.operators import tabular as T


def test_time_features(spark):
    df = spark.createDataFrame([(1, "2024-01-06 13:00:00"), (2, "garbage"), (3, None)], "i int, t string")
    a, b, c = time_features(df, "t").orderBy("i").collect()
    assert (a.t_hour, a.t_dayofweek, a.t_day, a.t_month, a.t_is_weekend, a.t_epoch_seconds) == (13.0, 5.0, 6.0, 1.0, 1.0, 1704546000.0)
    assert b.t_hour is None and b.t_is_weekend == 0.0 and c.t_epoch_seconds is None
    assert time_features(df, "absent") is df


def test_time_features_need_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        with pytest.raises(ValueError, match="UTC"):
            time_features(spark.createDataFrame([("x",)], "t string"), "t")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_one_hot_shares_columns_over_splits(spark):
    train = spark.createDataFrame([(1.5, "b", True), (2.0, None, False)], "x double, c string, f boolean")
    valid = spark.createDataFrame([(3.0, "a")], "x double, c string")
    out = T.one_hot(T.union_splits({"train": train, "valid": valid}))
    assert out.columns == ["split", "x", "c___missing__", "c_a", "c_b", "f_False", "f_True", "f___missing__"]
    rows = {r.x: tuple(r)[2:] for r in out.collect()}
    assert rows == {1.5: (0, 0, 1, 0, 1, 0), 2.0: (1, 0, 0, 1, 0, 0), 3.0: (0, 1, 0, 0, 0, 1)}


def test_one_hot_of_many_categories_and_a_hot_one(spark):
    df = spark.createDataFrame([("train", str(i) if i < 600 else None, i) for i in range(6000)], "split string, c string, k int")
    assert len(T.one_hot(df).columns) == 2 + 601
    assert T.one_hot(df, values={"c": ["7", "5"]}).columns == ["split", "k", "c_5", "c_7"]
    active, index = T.one_hot_indices(df, ["k"])
    assert index.count() == 601 and active.where(F.size("active") == 1).count() == 6000
    hot = index.where("value = '__missing__'").first()["index"]
    assert active.where(F.col("active")[0] == hot).count() == 5400


def test_selection_and_separation(spark):
    df = spark.createDataFrame([(1, "Go", 2.0, "2024-01-01 00:00:00", "m")], "a int, label string, label_weight double, ts string, meta string")
    assert T.feature_frame(df, drop=["meta", "absent"], time_column="ts").columns == [
        "a", "ts_hour", "ts_dayofweek", "ts_day", "ts_month", "ts_is_weekend", "ts_epoch_seconds"]
    assert T.feature_frame(df, selected=["a"]).columns == ["a"]
    with pytest.raises(ValueError, match="lacks required columns"):
        T.select_features(df, ["a", "nope"])
    assert T.metadata(df, ["meta", "nope"]).columns == ["meta"]


def simulate(scores, patience):
    best, since, out = float("-inf"), 0, []
    for s in scores:
        improved = s > best
        best, since = (s, 0) if improved else (best, since + 1)
        out.append((improved, since))
        if since >= patience:
            break
    return out


@pytest.mark.parametrize("patience", [1, 2, 3])
def test_early_stopping_follows_the_loop(spark, patience):
    runs = {1: [0.1, 0.3, 0.3, 0.2, 0.4, 0.1], 2: [0.5, 0.4, 0.3, 0.2, 0.1, 0.9], 3: [None, 0.2, None, None, 0.3, 0.3]}
    rows = [(run, e + 1, s) for run, series in runs.items() for e, s in enumerate(series)]
    df = spark.createDataFrame(rows, "run int, epoch int, f1_macro double").withColumn("score", H.selection_score("f1_macro"))
    got = H.early_stopping(df, patience=patience).orderBy("run", "epoch").collect()
    for run, series in runs.items():
        want = simulate([float("-inf") if s is None else s for s in series], patience)
        assert [(r.improved, r.since_improvement) for r in got if r.run == run and r.ran] == want


def test_selection_scores(spark):
    df = spark.createDataFrame([(0.4, 1.5), (None, None)], "accuracy double, logloss double")
    assert [r[0] for r in df.select(H.selection_score("accuracy")).collect()] == [0.4, float("-inf")]
    assert [r[0] for r in df.select(H.selection_score("neg_logloss")).collect()] == [-1.5, float("-inf")]
    with pytest.raises(ValueError):
        H.selection_score("loss")


def test_histories_continue(spark):
    old = spark.createDataFrame([("train", 1, 0.9), ("train", 2, 0.8)], "dataset string, round int, value double")
    new = spark.createDataFrame([("train", 1, 0.7), ("valid", 1, 0.6)], "dataset string, round int, value double")
    got = {(r.dataset, r["round"]): r.value for r in H.merge_histories(old, new, ["dataset"]).collect()}
    assert got == {("train", 1): 0.9, ("train", 2): 0.8, ("train", 3): 0.7, ("valid", 1): 0.6}


def test_latest_checkpoint_is_numeric(spark):
    names = spark.createDataFrame([("model_50.json",), ("model_100.json",), ("model_9.json",)], "name string")
    assert H.latest_checkpoint(names).first().latest == "model_100.json"


def test_ranking_puts_missing_metrics_last(spark):
    rows = [("a", None, None, None), ("b", 0.5, 0.1, 0.9), ("c", 0.5, 0.2, 0.1), ("d", 0.6, None, None)]
    df = spark.createDataFrame(rows, "experiment_name string, valid_f1_macro double, valid_balanced_accuracy double, valid_accuracy double")
    assert [r.experiment_name for r in H.rank_runs(df).collect()] == ["d", "c", "b", "a"]
    assert H.best_run(df).first().experiment_name == "d"
