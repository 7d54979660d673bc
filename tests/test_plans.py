import time
from pathlib import Path

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from relvec import fixtures as X
from relvec.functions.scalars import text_key, user_available
from relvec.models import network
from relvec.operators.encode import HashEncoder
from relvec.operators.text_dictionary import attach_text_ids
from relvec.plans import ablation, feature_build
from relvec.plans.training import TrainingConfig, prepare, run
from relvec.session import shared_dir
from relvec.sources import records, tables
from relvec.streaming import incremental


@pytest.fixture(scope="module")
def training_input(spark):
    rows, store = X.interactions_and_store(spark, "/root/testdata/sf0.001")
    ready = attach_text_ids(rows, store).withColumn("embedding_user_available", user_available())
    return ready.drop("query_text", "user_profile_text", "candidate_text"), store


def test_feature_build_and_rerun(spark, tmp_path, small):
    rows = X.interactions(spark, small)
    splits, out = str(tmp_path / "splits"), str(tmp_path / "out")
    tables.write_splits(rows, splits)
    record = feature_build.build(spark, splits, out, lambda: HashEncoder(16), 16, "4,8")
    features = tables.read_features(spark, out + "/features")
    assert features.count() == rows.count()
    assert {"query_text", "qc_cosine_4", "quc_cosine_16", "embedding_user_available"} <= set(features.columns)
    cold = features.where("user_profile_text = 'coldstart'")
    assert cold.where("uc_cosine_16 <> 0 or qu_cosine_16 <> 0 or quc_cosine_16 <> qc_cosine_16").count() == 0
    assert record["embedded_now"] == sum(record["text_roles"].values())
    assert sorted(record["splits_now"]) == ["test", "train", "valid"]
    assert feature_build.build(spark, splits, out, lambda: HashEncoder(16), 16, "4,8")["splits_now"] == []
    # Fewer rows change counts and ids; no text is new, and ids still lead to the vector of their text.
    tables.write_splits(rows.where("event_id % 3 <> 0"), splits)
    again = feature_build.build(spark, splits, out, lambda: HashEncoder(16), 16, "4,8")
    assert again["embedded_now"] == 0
    assert spark.read.text(out + "/manifest").count() == 3
    features, store = tables.read_features(spark, out + "/features"), tables.read_store(spark, out + "/store")
    ids = store.where("role = 'candidate'").select(F.col("text_id").alias("candidate_text_id"), "text_key")
    checked = features.join(ids, "candidate_text_id").where(F.col("text_key") == text_key("candidate_text"))
    assert checked.count() == features.count() == rows.where("event_id % 3 <> 0").count()


@pytest.mark.parametrize("model", ["mlp", "lbfgs", "trees"])
def test_training_run_writes_everything(spark, tmp_path, training_input, model):
    settings = {
        "logreg": {"max_epochs": 1, "steps_per_epoch": 1}, "mlp": {"hidden": (4,), "max_epochs": 1, "steps_per_epoch": 1},
        "lbfgs": {"max_iter": 3}, "trees": {"rounds": 1, "depth": 2, "max_bins": 8},
    }[model]
    rows, store = training_input
    folder = str(tmp_path / "run")
    mode = "original" if model == "trees" else "merged3"
    record = run(spark, rows, store, TrainingConfig(model, 4, mode, "balanced-sample-weight", settings=settings), folder)
    assert record["num_classes"] == (5 if mode == "original" else 3)
    predictions = spark.read.parquet(folder + "/predictions")
    assert predictions.count() == rows.count()
    assert predictions.where("split <> 'train' and effective_sample_weight is not null").count() == 0
    assert {"original_label", "prediction_confidence", "predicted_label"} <= set(predictions.columns)
    assert record["weight_sanitization"]["train"]["weight_count"] == rows.where("split = 'train'").count()
    assert sum(record["coldstart_rows"].values()) == rows.where("embedding_user_available = 0").count()
    assert set(record["metrics"]) == {"train", "valid", "test"} and len(record["class_weight_map"]) == record["num_classes"]
    assert spark.read.csv(folder + "/artifacts/feature_importance", header=True).count() == 12
    assert spark.read.json(folder + "/artifacts/history").count() > 0
    assert spark.read.json(folder + "/artifacts/run_summary").count() == 1


def test_tree_inputs_keep_cold_users(spark, training_input):
    rows, store = training_input
    cold = lambda model: prepare(rows.where("embedding_user_available = 0"), store, TrainingConfig(model, 4)).rows
    used = F.exists(F.slice("features_int8", 5, 4), lambda x: x != 0)
    assert cold("logreg").where(used).count() == 0
    assert cold("trees").where(used).count() > 0


def test_grid_records_failures(spark, tmp_path, training_input):
    rows, store = training_input
    configs = ablation.grid(["logreg", "mlp"], [4, 8], ["off"], [{"hidden": (4,), "dropout": 0.15}])
    assert [ablation.experiment_name(c) for c in configs] == ["logreg_rawdim4_off", "logreg_rawdim8_off", "mlp_4_d015_rawdim4_off", "mlp_4_d015_rawdim8_off"]

    def runner(spark, rows, store, config, folder):
        if config.dim == 8:
            raise RuntimeError("broken")
        return {"run_dir": folder}

    manifest, found = ablation.run_grid(spark, rows, store, configs, str(tmp_path), parallel=2, runner=runner)
    assert ablation.failed(manifest) == ["logreg_rawdim8_off", "mlp_4_d015_rawdim8_off"]
    assert found[1]["error"] == "broken"
    empty = spark.createDataFrame([], "run string, split string, metric string, value double")
    assert ablation.summarize(manifest, empty).count() == 4


def test_grid_goes_on_with_what_is_missing(spark, tmp_path, training_input):
    rows, store = training_input
    configs = ablation.grid(["logreg"], [4, 8, 16], ["off"])
    calls, broken = [], {8}

    def runner(spark, rows, store, config, folder):
        calls.append((config.dim, spark.sparkContext.getLocalProperty("spark.scheduler.pool")))
        spark.range(10).count()
        if config.dim in broken:
            raise RuntimeError("killed")
        return {"run_dir": folder, "best": config.dim}

    go = lambda rows, **more: ablation.run_grid(spark, rows, store, configs, str(tmp_path), runner=runner, **more)
    manifest, _ = go(rows, parallel=3)
    assert ablation.failed(manifest) == ["logreg_rawdim8_off"]
    assert sorted(calls) == [(d, f"logreg_rawdim{d}_off") for d in (4, 8, 16)]
    calls.clear()
    broken.clear()
    manifest, found = go(rows, parallel=2, resume=True)
    assert [d for d, _ in calls] == [8] and ablation.failed(manifest) == []
    assert [r["best"] for r in found] == [4, 8, 16] and manifest.count() == 3
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    calls.clear()
    go(rows, resume=True)
    assert calls == []
    go(rows.where("event_id % 2 = 0"), resume=True)  # other rows: nothing found before holds
    assert sorted(d for d, _ in calls) == [4, 8, 16]
    calls.clear()
    configs[0].settings["max_epochs"] = 3
    go(rows.where("event_id % 2 = 0"), resume=True)
    assert [d for d, _ in calls] == [4]
    with pytest.raises(ValueError, match="share a name"):
        ablation.run_grid(spark, rows, store, [configs[0], configs[0]], str(tmp_path), runner=runner)


def test_failed_run_is_cancelled_whole(spark, tmp_path, training_input):
    rows, store = training_input
    configs = ablation.grid(["logreg"], [4, 8], ["off"])
    ended = {}

    def slow(spark, seconds):
        def wait(parts):
            for part in parts:
                time.sleep(seconds)
                yield part

        return spark.range(2, numPartitions=1).mapInPandas(wait, "id long").count()

    def runner(spark, rows, store, config, folder):
        if config.dim == 8:
            return {"run_dir": folder, "rows": slow(spark, 3)}  # beside the other run, and not touched
        side = InheritableThread(target=lambda: ended.update(error=_error_of(lambda: slow(spark, 60))))
        side.start()
        ended["side"] = side
        time.sleep(2)
        raise RuntimeError("broken")

    begun = time.monotonic()
    manifest, found = ablation.run_grid(spark, rows, store, configs, str(tmp_path), parallel=2, runner=runner)
    ended["side"].join(30)
    assert time.monotonic() - begun < 50 and "cancelled" in ended["error"]
    assert ablation.failed(manifest) == ["logreg_rawdim4_off"] and found[1]["rows"] == 2


def _error_of(job):
    try:
        return job() and ""
    except Exception as error:
        return str(error).lower()


def test_grid_summary_is_written_before_failing(spark, tmp_path, training_input):
    rows, store = training_input
    common = {"max_epochs": 1, "steps_per_epoch": 1}
    configs = ablation.grid(["logreg"], [4, 4000], ["off"], common=common)
    with pytest.raises(RuntimeError, match="logreg_rawdim4000_off"):
        ablation.run_and_summarize(spark, rows, store, configs, str(tmp_path))
    best, broken = spark.read.csv(f"{tmp_path}/reports/summary", header=True).collect()
    assert (best.experiment_name, best.feature_count, best.best_epoch) == ("logreg_rawdim4_off", "12", "1")
    assert float(best.valid_f1_macro) > 0
    assert (broken.status, broken.valid_f1_macro) == ("failed", None)


def test_bad_options():
    with pytest.raises(ValueError, match="unsupported model"):
        TrainingConfig("forest")
    with pytest.raises(ValueError, match="imbalance"):
        TrainingConfig(imbalance="smote")


def test_stream_processes_new_files_only(spark, tmp_path, small):
    rows, store = X.interactions_and_store(spark, small)
    folder = str(tmp_path)
    tables.write_store(store, f"{folder}/store")
    rows.where("event_id % 2 = 0").coalesce(2).write.parquet(f"{folder}/in")

    def go():
        query = incremental.feature_stream(spark, f"{folder}/in", rows.schema, f"{folder}/store", [64], f"{folder}/out", f"{folder}/cp", 1)
        query.awaitTermination()
        return incremental.stream_progress(spark, query).agg(F.sum("rows")).first()[0] or 0

    total = rows.count()
    assert go() == total // 2
    assert go() == 0
    rows.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    assert go() == total - total // 2
    out = incremental.read_stream_features(spark, f"{folder}/out")
    assert out.count() == total == out.select("event_id").distinct().count()
    progress = incremental.written_progress(spark, f"{folder}/out").collect()
    assert sum(r.rows for r in progress) == total and len({r.batch for r in progress}) == len(progress) >= 2
    assert incremental.written_progress(spark, f"{folder}/none").count() == 0


def test_embedding_is_committed_slice_by_slice(spark, tmp_path, small):
    dictionary = X.text_dictionary(X.interactions(spark, small)).where("role = 'candidate'")
    folder, total, made = str(tmp_path / "v"), dictionary.count(), []
    write = incremental.write_store

    def broken(frame, path):
        if len(made) == 3:
            raise RuntimeError("lost")
        write(frame, path)
        made.append(1)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(incremental, "write_store", broken)
        with pytest.raises(RuntimeError, match="lost"):
            incremental.embed_pending(spark, dictionary, folder, lambda: HashEncoder(8), 8, slices=2, texts_per_commit=40)
    kept = spark.read.parquet(folder).count()
    progress = spark.read.parquet(folder + "_progress").collect()
    assert kept == sum(r.texts for r in progress) == max(r.finished for r in progress) < total and len(progress) == 3
    left = incremental.embed_pending(spark, dictionary, folder, lambda: HashEncoder(8), 8, slices=2, texts_per_commit=40)
    stored = spark.read.parquet(folder)
    assert left == total - kept and stored.count() == stored.select("text_key").distinct().count() == total
    assert incremental.embed_pending(spark, dictionary, folder, lambda: HashEncoder(8), 8) == 0


def test_stream_without_texts_writes_none_and_has_the_same_features(spark, tmp_path, small):
    rows, store = X.interactions_and_store(spark, small)
    folder = str(tmp_path)
    tables.write_store(store, f"{folder}/store")
    rows.coalesce(2).write.parquet(f"{folder}/in")
    found = {}
    for texts in (True, False):
        out = f"{folder}/out_{texts}"
        incremental.feature_stream(
            spark, f"{folder}/in", rows.schema, f"{folder}/store", [64], out, f"{folder}/cp_{texts}", 1, texts=texts
        ).awaitTermination()
        found[texts] = incremental.read_stream_features(spark, out)
    names = {"query_text", "user_profile_text", "candidate_text"}
    assert set(found[True].columns) - set(found[False].columns) == names
    same = found[False].columns
    assert sorted(found[True].select(same).collect(), key=str) == sorted(found[False].collect(), key=str)


def test_long_texts_are_joined_last_and_not_carried_on(spark, small):
    from relvec.registry import queries as Q

    keyed, _ = Q._keyed_rows(spark, small)
    assert not {"query_text", "user_profile_text", "candidate_text"} & set(keyed.columns)
    assert keyed.count() == X.interactions(spark, small).count()
    plan = X.interactions(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "doc_id" in joins[0] and "c_custkey" in joins[1]


def test_runs_leave_nothing_but_their_folders(spark, tmp_path, training_input):
    rows, store = training_input
    scratch = Path(shared_dir(spark)) / "relvec" / spark.sparkContext.applicationId
    before = set(scratch.iterdir())
    seen, evaluate = [], network.evaluate_wide

    def watched(*args, **named):
        seen.append(len([p for p in scratch.iterdir() if p.name.startswith(("valid_scores", "points", "ranges"))]))
        return evaluate(*args, **named)

    common = {"max_epochs": 3, "steps_per_epoch": 1}
    configs = ablation.grid(["logreg"], [4, 8], ["off"], common=common)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(network, "evaluate_wide", watched)
        manifest, _ = ablation.run_grid(spark, rows, store, configs, str(tmp_path))
    assert ablation.failed(manifest) == [] and seen == [1] * 6  # the scores of one epoch at a time
    assert set(scratch.iterdir()) == before
    folders = [p for p in (tmp_path / "runs").iterdir()]
    assert len(folders) == 2 and all({c.name for c in f.iterdir()} == {"artifacts", "checkpoints", "predictions"} for f in folders)
    more = TrainingConfig("logreg", 4, settings={**common, "max_epochs": 4})
    folder = str(tmp_path / "runs" / "logreg_rawdim4_off")
    run(spark, rows, store, more, folder, resume=True)  # the batches are dealt again
    assert spark.read.json(f"{folder}/artifacts/history").count() == 4
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_grid_query_trains_every_length_with_whole_settings(spark, small, monkeypatch):
    from relvec.registry import queries as Q

    asked = []

    def run_grid(spark, rows, store, configs, *more, **named):
        asked.extend(configs)
        raise RuntimeError("asked")

    monkeypatch.setattr(ablation, "run_grid", run_grid)
    with pytest.raises(RuntimeError, match="asked"):
        Q.ablation_grid(spark, small)
    assert {(c.model, c.dim, c.imbalance) for c in asked} == {
        (m, d, i) for m in ("logreg", "mlp") for d in X.DIMS for i in ("off", "balanced-sample-weight")
    } and len(asked) == 12
    for config in asked:
        make = network.logistic_settings if config.model == "logreg" else network.mlp_settings
        assert make(**config.settings) == make()  # 40 epochs; 1024 and 512 units
