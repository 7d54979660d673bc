import pytest
from pyspark.sql import functions as F

from relvec import fixtures as X
from relvec.operators import metrics as M
from relvec.plans import ablation
from relvec.schema import LABEL_ORDER
from relvec.sources import records, responses, tables


def test_missing_split_raises(spark, tmp_path, small):
    rows = X.interactions(spark, small)
    tables.write_splits(rows, str(tmp_path), ["train", "valid"])
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        tables.read_splits(spark, str(tmp_path))
    back = tables.read_splits(spark, str(tmp_path), ["train", "valid"])
    assert back.count() == rows.where("split <> 'test'").count()


def test_split_read_prunes_directories(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 1, "train"), (2, 2, 2, "valid")], "query_text_id int, user_text_id int, candidate_text_id int, split string")
    tables.write_features(df, str(tmp_path / "f"))
    one = tables.read_features(spark, str(tmp_path / "f"), "valid")
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    tables.write_features(df.where("split = 'valid'").withColumn("query_text_id", F.lit(9)), str(tmp_path / "f"))
    rows = {r.split: r.query_text_id for r in tables.read_features(spark, str(tmp_path / "f")).collect()}
    assert rows == {"train": 1, "valid": 9}


def test_features_need_id_columns(spark, tmp_path):
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "f"))
    with pytest.raises(ValueError, match="lacks required columns"):
        tables.read_features(spark, str(tmp_path / "f"))


def test_base64_golden_and_wrong_length(spark):
    df = spark.createDataFrame([("AH+A/w==",)], "b string")
    assert list(df.select(responses.decode_base64(F.col("b"), 4).alias("v")).first().v) == [0, 127, -128, -1]
    again = df.select(responses.encode_base64(F.array(*[F.lit(x).cast("tinyint") for x in (0, 127, -128, -1)])))
    assert again.first()[0] == "AH+A/w=="
    with pytest.raises(Exception, match="expected 3 dimensions, got 4"):
        df.select(responses.decode_base64(F.col("b"), 3)).collect()


def test_prediction_frame_columns(spark):
    df = spark.createDataFrame([(7, "valid", 1, "Why not", [0.5, 0.5])], "event_id int, split string, label_id int, label string, probs array<double>")
    out = tables.prediction_frame(df, ["Go", "Why not"])
    assert out.columns == ["event_id", "split", "label_id", "label", "predicted_label_id", "predicted_label", "prediction_confidence", "prob_go", "prob_why_not"]
    assert tuple(out.first())[4:] == (0, "Go", 0.5, 0.5, 0.5)


def test_pretty_printed_metrics_and_failed_runs(spark, tmp_path):
    """Nulls inside the metrics, a run without files, and two ranked runs."""
    for run, f1 in (("a", "0.4"), ("b", "null")):
        folder = tmp_path / "runs" / run / "artifacts"
        folder.mkdir(parents=True)
        (folder / "metrics.json").write_text('{\n  "valid": {\n    "f1_macro": %s,\n    "accuracy": 0.5\n  },\n  "test": {"f1_macro": 0.1}\n}' % f1)
    rows = [(n, "logreg", "off", 256, f"runs/{n}", f"logs/{n}", s) for n, s in (("a", "success"), ("b", "success"), ("c", "failed"))]
    records.write_manifest(spark.createDataFrame(rows, records.MANIFEST_SCHEMA), str(tmp_path / "manifest"))
    tall = records.read_metrics_json(spark, f"{tmp_path}/runs/*/artifacts/metrics.json", r"runs/([^/]+)/")
    extra = spark.createDataFrame([("a", 768, 3)], "run string, feature_count int, best_epoch int")
    out = ablation.summarize(records.read_manifest(spark, str(tmp_path / "manifest")), tall, extra).collect()
    assert [r.experiment_name for r in out] == ["a", "b", "c"]
    assert (out[0].valid_f1_macro, out[0].test_f1_macro, out[0].best_epoch, out[1].valid_accuracy, out[2].valid_accuracy) == (0.4, 0.1, 3, 0.5, None)
    assert list(out[0].asDict()) == list(records.SUMMARY_COLUMNS)


def test_metric_files_round_trip(spark, tmp_path, small):
    tall = M.evaluate_split(X.predictions(spark, small), len(LABEL_ORDER)).withColumn("run_dir", F.lit("r1"))
    records.write_metrics_json(tall, str(tmp_path / "m"))
    back = records.read_metrics_json(spark, f"{tmp_path}/m/*/*", r"run_dir=([^/]+)/")
    same = {(r.split, r.metric, r.value) for r in back.collect()}
    assert same == {(r.split, r.metric, r.value) for r in tall.collect()}
