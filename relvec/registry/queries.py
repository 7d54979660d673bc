"""One query per operator. Each takes (spark, table folder) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relvec import fixtures as X
from relvec.functions import probabilities as P
from relvec.functions import scalars as S
from relvec.functions import vectors as V
from relvec.models import linear, network, trees
from relvec.operators import calibration as C
from relvec.operators import features as FE
from relvec.operators import history as H
from relvec.operators import labels as L
from relvec.operators import metrics as M
from relvec.operators import tabular as TB
from relvec.operators import text_dictionary as TD
from relvec.operators import weights as Wt
from relvec.plans import ablation
from relvec.plans.training import TrainingConfig, prepare
from relvec.schema import LABEL_ORDER, ROLE_TEXT, ROLES, SPLITS
from relvec.session import materialize, scratch_path, shuffle_partitions
from relvec.sources import bucketed, records, responses, tables
from relvec.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
K = len(LABEL_ORDER)
FEATURE_KEYS = ("event_id", "user_id", "search_id", "profil_id", "split", "label")


def query(name: str):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return keep


def joined_text(vector: Column) -> Column:
    """Components as text, the one form in which both engines print arrays alike."""
    return F.array_join(F.transform(vector, lambda x: x.cast("string")), ",")


def _rounded_cosines(df: DataFrame) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in df.columns if "_cosine_" in c]


def no_text(df: DataFrame) -> DataFrame:
    return df.drop(*ROLE_TEXT.values())


# ---- sources and sinks ----


@query("split_scan_counts")
def split_scan_counts(spark, sf):
    folder = scratch_path(spark, "splits")
    tables.write_splits(X.interactions(spark, sf), folder)
    rows = tables.read_splits(spark, folder)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("event_sum"), F.sum(F.length("candidate_text")).alias("chars")
    )


def _id_rows(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Interactions with text ids, and the dictionary they come from."""
    rows = X.interactions(spark, sf)
    dictionary = TD.text_dictionary(rows)
    return TD.attach_text_ids(rows, dictionary), dictionary


def _keyed_rows(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Interactions with text keys and the availability flag instead of texts, stored once, and their vectors.

    All that follows reads these narrow rows; the texts are joined and hashed for them only once.
    """
    rows, store = X.interactions_and_store(spark, sf)
    keyed = TD.with_text_keys(rows.withColumn("embedding_user_available", S.user_available()))
    return materialize(no_text(keyed), "keyed"), store


@query("feature_split_roundtrip")
def feature_split_roundtrip(spark, sf):
    rows, store = _keyed_rows(spark, sf)
    folder = scratch_path(spark, "features")
    tables.write_features(
        FE.cosine_features(rows.drop("embedding_user_available"), store, X.DIMS, once_per_triple=True), folder
    )
    back = M.metric_union([tables.read_features(spark, folder, s) for s in SPLITS])
    return back.select("event_id", "split", "query_text_id", "user_text_id", "candidate_text_id", *_rounded_cosines(back))


@query("store_roundtrip")
def store_roundtrip(spark, sf):
    _, store = X.interactions_and_store(spark, sf)
    folder = scratch_path(spark, "store")
    tables.write_store(store, folder)
    return tables.read_store(spark, folder).select(
        "role", "text_id", "source_count", joined_text(F.col("embedding")).alias("embedding")
    )


@query("bucketed_lookup")
def bucketed_lookup(spark, sf):
    """Ids and vectors of every interaction from a bucketed store, written role by role."""
    rows, store = X.interactions_and_store(spark, sf)
    folder = scratch_path(spark, "store")
    for role in ROLES:
        bucketed.write_bucketed_store(store.where(F.col("role") == role), folder)
    found = FE.attach_ids_and_vectors(TD.with_text_keys(rows), tables.read_store(spark, folder))
    return found.select(
        "event_id", "query_text_id", "user_text_id", "candidate_text_id",
        *[joined_text(F.col(v)).alias(v) for v in FE.VECTOR.values()],
    )


@query("metrics_wide")
def metrics_wide(spark, sf):
    folder = scratch_path(spark, "metrics")
    records.write_csv(M.to_wide(M.evaluate_split(X.stored_predictions(spark, sf), K)), folder)
    schema = "split string, " + ", ".join(f"`{m}` double" for m in M.METRICS)
    return spark.read.schema(schema).csv(folder, header=True)


@query("run_metrics_flat")
def run_metrics_flat(spark, sf):
    folder = scratch_path(spark, "runs")
    records.write_metrics_json(X.run_metrics(spark, sf), folder)
    tall = records.read_metrics_json(spark, f"{folder}/*/*", r"run_dir=([^/]+)/")
    return records.flatten_metrics(tall, list(M.METRICS))


@query("run_metadata")
def run_metadata(spark, sf):
    """Run records as appended JSON lines, read back as one table."""
    folder = scratch_path(spark, "records")
    per_split = X.interactions(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(S.is_cold_text()).alias("cold")
    )
    record = {"embedding_prefix_dim": X.DIM, "coldstart_zeroed_rows": {r["split"]: r["cold"] for r in per_split.collect()}}
    records.append_run_record(spark, {"run": "a", **record}, folder)
    records.append_run_record(spark, {"run": "b", **record}, folder)
    schema = "run string, embedding_prefix_dim int, coldstart_zeroed_rows map<string,bigint>"
    return records.read_run_records(spark, folder, schema).select(
        "run", "embedding_prefix_dim", F.explode("coldstart_zeroed_rows").alias("split", "cold_rows")
    )


@query("base64_ingest")
def base64_ingest(spark, sf):
    folder = scratch_path(spark, "responses")
    vectors = X.quantized(spark, sf)
    item = F.struct((F.col("vec_id") % 64).cast("int").alias("index"), responses.encode_base64(F.col("embedding")).alias("embedding"))
    batch = F.expr("vec_id div 64").alias("batch")
    # 64 items a line, last one first, as a service may answer out of order
    lines = vectors.select(batch, item.alias("item")).groupBy("batch").agg(
        F.sort_array(F.collect_list("item"), asc=False).alias("data")
    )
    lines.write.json(folder)
    return responses.read_responses(spark, folder, X.DIM).withColumn("embedding", joined_text(F.col("embedding")))


# ---- texts and ids ----


def _dictionary(role: str) -> Query:
    def run(spark, sf):
        return TD.text_dictionary(X.interactions(spark, sf), [role]).select("text_id", "text", "source_count")

    return run


for _role in ROLES:
    QUERIES[f"text_dictionary_{_role}"] = _dictionary(_role)


@query("all_role_texts")
def all_role_texts(spark, sf):
    return TD.text_counts(X.interactions(spark, sf))


@query("role_ids_joined")
def role_ids_joined(spark, sf):
    rows, _ = _id_rows(spark, sf)
    return rows.select("event_id", "split", "query_text_id", "user_text_id", "candidate_text_id")


@query("pending_texts")
def pending_texts(spark, sf):
    """Texts that embedding the validation split alone leaves to do."""
    rows = X.interactions(spark, sf)
    everything = TD.text_dictionary(rows)
    seen = TD.role_texts(rows.where(F.col("split") == "valid")).distinct().withColumn("text_key", S.text_key("text"))
    return TD.pending(everything, seen).select("role", "text_id", "text_key", "source_count")


@query("progress")
def progress(spark, sf):
    rows = X.interactions(spark, sf)
    everything = TD.text_counts(rows).withColumn("text_key", S.text_key("text"))
    seen = TD.role_texts(rows.where(F.col("split") == "valid")).distinct().withColumn("text_key", S.text_key("text"))
    return TD.completion(everything, seen, ["role"], ["role", "text_key"])


# ---- vectors ----


@query("quantized_vectors")
def quantized_vectors(spark, sf):
    return X.quantized(spark, sf).select("vec_id", joined_text(F.col("embedding")).alias("embedding"))


@query("prefix_slices")
def prefix_slices(spark, sf):
    cuts = F.array(*[
        F.struct(F.lit(d).alias("dim"), joined_text(V.prefix("embedding", d)).alias("prefix")) for d in X.DIMS
    ])
    return X.quantized(spark, sf).select("vec_id", F.inline(cuts))


@query("l2_normalized")
def l2_normalized(spark, sf):
    return X.quantized(spark, sf).select(
        "vec_id", F.posexplode(V.l2_normalized("embedding")).alias("position", "x")
    ).withColumn("x", F.round("x", 6))


@query("scaled_inputs")
def scaled_inputs(spark, sf):
    return X.quantized(spark, sf).select("vec_id", F.posexplode(V.scaled("embedding")).alias("position", "x")).withColumn(
        "x", F.round("x", 6)
    )


def _features(spark, sf) -> DataFrame:
    rows, store = X.interactions_and_store(spark, sf)
    return FE.cosine_features(rows, store, X.DIMS)


@query("prefix_cosine_features")
def prefix_cosine_features(spark, sf):
    out = _features(spark, sf)
    cosines = [c for c in out.columns if "_cosine_" in c]
    return out.select(
        *FEATURE_KEYS, "query_text_id", "user_text_id", "candidate_text_id", "embedding_user_available",
        *[F.round(c, 6).alias(c) for c in cosines],
    )


def _cosine(kind: str) -> Query:
    def run(spark, sf):
        values = F.array(*[
            F.struct(F.lit(d).alias("dim"), F.round(f"{kind}_cosine_{d}", 6).alias("cosine")) for d in X.DIMS
        ])
        return _features(spark, sf).select("event_id", F.inline(values))

    return run


for _kind in ("qc", "uc", "qu", "quc"):
    QUERIES[f"cosine_{_kind}"] = _cosine(_kind)


@query("prefix_dots_arrow")
def prefix_dots_arrow(spark, sf):
    rows, store = X.interactions_and_store(spark, sf)
    rows = FE.attach_ids_and_vectors(TD.with_text_keys(rows), store)
    sums = rows.select("event_id", V.prefix_sums(*(F.col(FE.VECTOR[r]) for r in ROLES), X.DIMS).alias("s"))
    per_dim = F.array(*[
        F.struct(F.lit(d).alias("dim"), *[F.get(F.col("s")[p], F.lit(i)).alias(p) for p in V.PAIRS]) for i, d in enumerate(X.DIMS)
    ])
    return sums.select("event_id", F.inline(per_dim))


@query("role_vectors_joined")
def role_vectors_joined(spark, sf):
    rows, store = X.interactions_and_store(spark, sf)
    with_ids = TD.attach_text_ids(rows, store)
    gathered = FE.attach_vectors(with_ids, store)
    return gathered.select("event_id", *[joined_text(F.col(FE.VECTOR[r])).alias(f"{r}_vector") for r in ROLES])


def _vector_rows_of(rows: DataFrame, store: DataFrame) -> DataFrame:
    return FE.attach_ids_and_vectors(TD.with_text_keys(rows), store)


def _vector_rows(spark, sf) -> DataFrame:
    return _vector_rows_of(*X.interactions_and_store(spark, sf))


@query("zeroed_concat")
def zeroed_concat(spark, sf):
    rows = _vector_rows(spark, sf).withColumn("embedding_user_available", S.user_available())
    return FE.feature_vector(rows, X.DIM).select("event_id", joined_text(F.col("features_int8")).alias("features"))


@query("named_vector_columns")
def named_vector_columns(spark, sf):
    rows = _vector_rows(spark, sf)
    return rows.select("event_id", *[c for r in ROLES for c in V.named_columns(FE.VECTOR[r], r, X.DIM)])


@query("coldstart_flag")
def coldstart_flag(spark, sf):
    return X.interactions(spark, sf).select("event_id", S.user_available().alias("embedding_user_available"))


@query("coldstart_ladder")
def coldstart_ladder(spark, sf):
    """The same interactions under each rule; the columns present pick the rule."""
    rows = X.interactions(spark, sf).select("event_id", "user_id", "user_profile_text")
    kind = F.col("event_id") % 4
    shapes = {
        "available": rows.withColumn("embedding_user_available", F.when(kind == 0, "x").when(kind == 1, "0").when(kind == 2, "1")),
        "flag": rows.withColumn("is_coldstart", F.when(kind == 0, "TRUE").when(kind == 1, "yes").when(kind == 2, "no")),
        "text": rows.withColumn("user_profile_text", F.when(kind == 0, F.upper("user_profile_text")).otherwise(F.col("user_profile_text"))),
        "none": rows.drop("user_profile_text"),
    }
    return M.metric_union([
        df.select("event_id", F.lit(rule).alias("rule"), S.cold_start(df).alias("cold")) for rule, df in shapes.items()
    ])


@query("audit_counts")
def audit_counts(spark, sf):
    return FE.audit_counts(X.interactions(spark, sf))


# ---- labels and weights ----


def _merged(mode: str) -> Query:
    def run(spark, sf):
        return X.interactions(spark, sf).select("event_id", L.merged_label("label", mode).alias("label"))

    return run


QUERIES["labels_merged3"] = _merged("merged3")
QUERIES["labels_merged2"] = _merged("merged2")


def _train(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("split") == "train")


@query("class_list")
def class_list(spark, sf):
    """Two preferred labels first, the others sorted behind them."""
    return L.class_list(_train(X.interactions(spark, sf)), preferred=("Why not", "Go", "Absent"))


def _encoded(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = X.interactions(spark, sf)
    classes = L.class_list(_train(rows))
    return L.encode_labels(rows, classes), classes


@query("labels_encoded")
def labels_encoded(spark, sf):
    return _encoded(spark, sf)[0].select("event_id", "label", "label_id")


@query("labels_decoded")
def labels_decoded(spark, sf):
    rows = M.scored(X.predictions(spark, sf))
    return L.decode_labels(rows, LABEL_ORDER, "predicted_id", "predicted_label").select("event_id", "predicted_label")


@query("label_names_sanitized")
def label_names_sanitized(spark, sf):
    labels = X.interactions(spark, sf).select("label")
    names = M.metric_union([
        *[labels.select(L.merged_label("label", m).alias("label")) for m in L.LABEL_MODES],
        X.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("label")),
        X.table(spark, sf, "part").select(F.col("p_brand").alias("label")),
    ])
    return names.distinct().withColumn("name", S.safe_label_name("label"))


@query("unknown_labels")
def unknown_labels(spark, sf):
    rows = X.interactions(spark, sf)
    classes = L.class_list(_train(rows).where(F.col("label") != "Out of scope"))
    return L.unknown_labels(rows.where(F.col("split") != "train"), classes)


@query("class_weights")
def class_weights(spark, sf):
    rows, classes = _encoded(spark, sf)
    return Wt.class_weights(_train(rows), classes).withColumn("class_weight", F.round("class_weight", 6))


@query("effective_weights")
def effective_weights(spark, sf):
    rows, classes = _encoded(spark, sf)
    weighted = Wt.training_weights(rows, Wt.class_weights(_train(rows), classes))
    return weighted.select("event_id", F.round("effective_sample_weight", 6).alias("weight"))


def bad_weight() -> Column:
    """Weights as the events carry them, with every defect mixed in."""
    kind, w = F.col("event_id") % 7, F.col("label_weight")
    return (
        F.when(kind == 0, float("nan")).when(kind == 1, float("inf")).when(kind == 2, float("-inf"))
        .when(kind == 3, 0.0).when(kind == 4, -w).otherwise(w)
    )


@query("weight_sanitize_stats")
def weight_sanitize_stats(spark, sf):
    return Wt.weight_stats(X.interactions(spark, sf).withColumn("w", bad_weight()), "w")


@query("sanitized_weights")
def sanitized_weights(spark, sf):
    return X.interactions(spark, sf).select("event_id", F.round(S.positive_weight(bad_weight()), 6).alias("weight"))


@query("label_distribution")
def label_distribution(spark, sf):
    return L.label_distribution(X.interactions(spark, sf))


@query("label_order")
def label_order(spark, sf):
    return L.label_distribution(X.interactions(spark, sf)).orderBy("split", "label")


# ---- tabular ----


@query("time_features")
def time_features(spark, sf):
    events = X.table(spark, sf, "events").select("event_id", "ts")
    raw = F.when(F.col("event_id") % 11 == 0, "garbage").when(F.col("event_id") % 11 == 1, None).otherwise(
        F.col("ts").cast("string")
    )
    return S.time_features(events.withColumn("ts", raw), "ts").withColumn("ts_epoch_seconds", F.round("ts_epoch_seconds", 3))


@query("one_hot")
def one_hot(spark, sf):
    """Splits with differing columns: only training rows carry the order flag."""
    rows = X.interactions(spark, sf).select("event_id", "label", "label_weight", "split", (F.col("user_id") % 2 == 0).alias("even"))
    frames = {s: rows.where(F.col("split") == s).drop("split") for s in SPLITS}
    frames["valid"] = frames["valid"].drop("even")
    return TB.one_hot(TB.union_splits(frames))


@query("one_hot_sparse")
def one_hot_sparse(spark, sf):
    rows = X.interactions(spark, sf).select("event_id", "label", "user_profile_text", "split")
    active, index = TB.one_hot_indices(rows, ["event_id"])
    return active.select("event_id", joined_text(F.col("active")).alias("active"))


@query("selected_features")
def selected_features(spark, sf):
    rows = no_text(X.interactions(spark, sf))
    frame = TB.feature_frame(rows, drop=["split", "absent"], time_column="ts")
    return TB.select_features(frame, ["event_id", "ts_hour", "ts_dayofweek", "user_id"])


@query("metadata_projection")
def metadata_projection(spark, sf):
    return TB.metadata(X.interactions(spark, sf), ["event_id", "absent", "search_id", "split"])


# ---- probabilities and predictions ----


@query("softmax_probs")
def softmax_probs(spark, sf):
    preds = X.predictions(spark, sf).select("event_id", F.transform("probs", lambda p: p * 8.0).alias("logits"))
    return preds.select("event_id", F.posexplode(P.softmax("logits")).alias("class_id", "p")).withColumn("p", F.round("p", 6))


@query("prediction_frame")
def prediction_frame(spark, sf):
    frame = tables.prediction_frame(X.predictions(spark, sf), LABEL_ORDER)
    floats = [c for c in frame.columns if c.startswith("prob_") or c in ("prediction_confidence", "label_weight")]
    return frame.withColumns({c: F.round(c, 6) for c in floats})


@query("binary_probs")
def binary_probs(spark, sf):
    p = P.two_class(F.get("probs", F.lit(0)))
    return X.predictions(spark, sf).select("event_id", p.alias("p")).select(
        "event_id", F.round(F.get("p", F.lit(0)), 6).alias("p0"), F.round(F.get("p", F.lit(1)), 6).alias("p1")
    )


@query("valid_test_rows")
def valid_test_rows(spark, sf):
    return tables.evaluation_splits(X.predictions(spark, sf)).select("event_id", "split")


@query("confusion_matrix")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(X.predictions(spark, sf), K)


def _cell_metric(name: str) -> Query:
    def run(spark, sf):
        wide = M.threshold_free_metrics(M.confusion_cells(X.predictions(spark, sf)))
        return wide.select("split", S.rounded(F.col(name)).alias("value"))

    return run


def _area_metric(name: str) -> Query:
    def run(spark, sf):
        return M.macro_areas(X.predictions(spark, sf), K).select("split", S.rounded(F.col(name)).alias("value"))

    return run


for _name in ("accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted"):
    QUERIES[f"metric_{_name}"] = _cell_metric(_name)
QUERIES["metric_log_loss"] = _cell_metric("logloss")
QUERIES["metric_roc_auc"] = _area_metric("roc_auc_ovr_macro")
QUERIES["metric_pr_auc"] = _area_metric("pr_auc_ovr_macro")


@query("cumulative_hits")
def cumulative_hits(spark, sf):
    points = M.score_points(X.predictions(spark, sf), K)
    out = M.cumulative_hits(points, ["split", "class_id"])
    return out.select("split", "class_id", F.round("score", 6).alias("score"), "pos", "neg", "cum_pos", "cum_neg")


@query("roc_curve_micro")
def roc_curve_micro(spark, sf):
    return M.roc_curve_micro(tables.evaluation_splits(X.predictions(spark, sf)), K)


@query("pr_curve_micro")
def pr_curve_micro(spark, sf):
    return M.pr_curve_micro(tables.evaluation_splits(X.predictions(spark, sf)), K)


@query("calibration_bins")
def calibration_bins(spark, sf):
    return C.calibration_bins(X.predictions(spark, sf))


@query("confidence_histogram")
def confidence_histogram(spark, sf):
    return C.confidence_histogram(X.stored_predictions(spark, sf))


@query("evaluate_split")
def evaluate_split(spark, sf):
    return M.evaluate_split(X.stored_predictions(spark, sf), K)


@query("evaluate_split_weighted")
def evaluate_split_weighted(spark, sf):
    return M.evaluate_wide(X.stored_predictions(spark, sf), K, weight="label_weight")


@query("weighted_cross_entropy")
def weighted_cross_entropy(spark, sf):
    return M.weighted_cross_entropy(X.predictions(spark, sf), weight="label_weight")


@query("rounded_metrics")
def rounded_metrics(spark, sf):
    """Shares per user; a user without purchases has no defined ratio."""
    per_user = X.interactions(spark, sf).groupBy("user_id").agg(
        F.count_if(F.col("label") == "Go").alias("go"), F.count_if(F.col("split") == "test").alias("held"), F.count(F.lit(1)).alias("n")
    )
    undefined = F.when(F.col("held") % 5 == 0, float("nan")).otherwise(F.col("go") / F.col("n"))
    return per_user.select("user_id", S.rounded(undefined).alias("share"))


# ---- histories and runs ----


def history_table(spark, sf) -> DataFrame:
    """Forty epochs per run of users: mean weight of the events that fall on an epoch."""
    rows = X.table(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("run"), (F.col("event_id") % 40 + 1).alias("epoch"), "value"
    )
    return rows.groupBy("run", "epoch").agg(
        F.round(F.avg("value"), 0).alias("f1_macro"), F.round(F.sum("value"), 2).alias("logloss"), F.count(F.lit(1)).alias("n")
    )


@query("history_best_patience")
def history_best_patience(spark, sf):
    history = history_table(spark, sf).withColumn("f1_macro", F.when(F.col("n") % 7 != 0, F.col("f1_macro")))
    scored = history.withColumn("score", H.selection_score("f1_macro"))
    out = H.early_stopping(scored, patience=6)
    finite = F.when(F.col("best_so_far") > float("-inf"), F.col("best_so_far"))
    return out.select("run", "epoch", "improved", finite.alias("best_so_far"), "since_improvement", "best_epoch", "ran")


@query("history_merged")
def history_merged(spark, sf):
    history = history_table(spark, sf).select("run", F.col("epoch").alias("round"), F.col("logloss").alias("value"))
    old = history.where(F.col("run") < 10).withColumn("dataset", F.lit("train"))
    new = history.where(F.col("run") >= 10).withColumn("run", F.col("run") - 5).withColumn("dataset", F.lit("train"))
    return H.merge_histories(old, new.select(*old.columns), ["dataset", "run"])


@query("latest_checkpoint")
def latest_checkpoint(spark, sf):
    names = X.table(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("run"), F.concat(F.lit("model_"), (F.col("event_id") % 150).cast("string"), F.lit(".json")).alias("name")
    )
    return H.latest_checkpoint(names, by=["run"])


@query("run_ranking")
def run_ranking(spark, sf):
    """Manifest and nested metric files written, read back, joined and ranked."""
    folder = scratch_path(spark, "grid")
    records.write_manifest(X.run_manifest(spark, sf), f"{folder}/manifest")
    records.write_metrics_json(X.run_metrics(spark, sf), f"{folder}/runs")
    manifest = records.read_manifest(spark, f"{folder}/manifest")
    tall = records.read_metrics_json(spark, f"{folder}/runs/*/*", r"run_dir=([^/]+)/")
    ranked = ablation.summarize(manifest, tall)
    return ranked.select("experiment_name", "status", "model_type", "embedding_prefix_dim", "class_imbalance_handling",
                         "valid_f1_macro", "valid_balanced_accuracy", "valid_accuracy", "test_f1_macro", "run_dir")


@query("best_run")
def best_run(spark, sf):
    tall = X.run_metrics(spark, sf).withColumnRenamed("run_dir", "run")
    return H.best_run(ablation.summarize(X.run_manifest(spark, sf), tall)).select("experiment_name", "valid_f1_macro")


# ---- incremental ----


@query("incremental_features")
def incremental_features(spark, sf):
    """Features from a file stream; the result equals the batch job."""
    folder = scratch_path(spark, "stream")
    rows, store = X.interactions_and_store(spark, sf)
    bucketed.write_bucketed_store(store, f"{folder}/store")
    # Files hold equal candidates side by side, so a text that repeats takes its space about once a file.
    dealt = rows.repartition(max(8, shuffle_partitions(spark)), "profil_id").sortWithinPartitions("profil_id")
    dealt.write.option("compression", "zstd").parquet(f"{folder}/in")
    files = len(spark.read.parquet(f"{folder}/in").inputFiles())
    stream = incremental.feature_stream(
        spark, f"{folder}/in", rows.schema, f"{folder}/store", X.DIMS, f"{folder}/out", f"{folder}/progress",
        files_per_batch=-(-files // 2), texts=False,
    )
    stream.awaitTermination()
    out = incremental.read_stream_features(spark, f"{folder}/out")
    return out.select("event_id", "split", "query_text_id", "user_text_id", "candidate_text_id", "embedding_user_available",
                      *_rounded_cosines(out))


@query("mock_embeddings")
def mock_embeddings(spark, sf):
    dictionary = TD.text_dictionary(X.interactions(spark, sf))
    store = dictionary.withColumn("embedding", V.hashed("text", X.DIM))
    return store.select("role", "text_id", joined_text(F.col("embedding")).alias("embedding"))


# ---- models ----

MODEL_DIM = X.DIM


def _training_rows(spark, sf, config: TrainingConfig):
    rows, store = _keyed_rows(spark, sf)
    return prepare(FE.attach_ids_and_vectors(rows, store), store, config)


def _scores(frame: DataFrame) -> DataFrame:
    return frame.select("event_id", "split", "label_id", P.top_class("probs").alias("predicted_label_id"),
                        F.round(P.confidence("probs"), 6).alias("prediction_confidence"))


def _parts(data):
    return [data.rows.where(F.col("split") == s) for s in ("train", "valid")]


@query("logreg_scores")
def logreg_scores(spark, sf):
    data = _training_rows(spark, sf, TrainingConfig("lbfgs", MODEL_DIM, imbalance="balanced-sample-weight"))
    train, _ = _parts(data)
    model = linear.train_logistic(linear.with_ml_vector(linear.dealt(train)), "effective_sample_weight", max_iter=100)
    return _scores(linear.score_logistic(model, linear.with_ml_vector(data.rows)))


@query("mlp_scores")
def mlp_scores(spark, sf):
    data = _training_rows(spark, sf, TrainingConfig("mlp", MODEL_DIM))
    train, valid = _parts(data)
    settings = network.mlp_settings(hidden=(64, 32), max_epochs=10)
    net, _ = network.train_network(train, valid, K, 3 * MODEL_DIM, settings, "effective_sample_weight")
    return _scores(net.score(data.rows))


def _fit_trees(spark, sf):
    data = _training_rows(spark, sf, TrainingConfig("trees", MODEL_DIM))
    settings = trees.TreeSettings(rounds=10, depth=4, learning_rate=0.3)
    known = trees.with_held_out(data.rows, "effective_sample_weight")
    return trees.train_trees(known, K, settings, "effective_sample_weight", "_held"), data


@query("gbt_scores")
def gbt_scores(spark, sf):
    model, data = _fit_trees(spark, sf)
    return _scores(model.score(data.rows))


@query("tree_importance")
def tree_importance(spark, sf):
    model, _ = _fit_trees(spark, sf)
    return linear.top_k(trees.tree_importance(spark, model, V.feature_names(MODEL_DIM)), 30, ["gain", "weight"])


@query("feature_importance_topk")
def feature_importance_topk(spark, sf):
    data = _training_rows(spark, sf, TrainingConfig("lbfgs", MODEL_DIM))
    train, _ = _parts(data)
    model = linear.train_logistic(linear.with_ml_vector(linear.dealt(train)), "effective_sample_weight", max_iter=100)
    return linear.top_k(linear.weight_importance(
        spark, model.coefficientMatrix.toArray(), V.feature_names(MODEL_DIM), "mean_abs_logit_weight"
    ))


@query("training_history")
def training_history(spark, sf):
    data = _training_rows(spark, sf, TrainingConfig("logreg", MODEL_DIM))
    train, valid = _parts(data)
    settings = network.logistic_settings(max_epochs=10)
    _, history = network.train_network(train, valid, K, 3 * MODEL_DIM, settings, "effective_sample_weight")
    return network.history_frame(spark, history)


@query("ablation_grid")
def ablation_grid(spark, sf):
    rows, store = X.interactions_and_store(spark, sf)
    with_ids = TD.attach_text_ids(rows, store).withColumn("embedding_user_available", S.user_available())
    # Gathered for all runs at once; each run cuts its own prefixes.
    stored = materialize(FE.attach_vectors(no_text(with_ids), store, S.cold_start(with_ids)), "features")
    # Widths of the networks and epochs are those of a training run: none is set here.
    configs = ablation.grid(["logreg", "mlp"], X.DIMS, ["off", "balanced-sample-weight"])
    root = scratch_path(spark, "grid")
    manifest, run_records = ablation.run_grid(spark, stored, store, configs, root, parallel=2)
    tall = records.read_metrics_json(spark, f"{root}/runs/*/artifacts/metrics/*/*", r"run_dir=([^/]+)/")
    return ablation.summarize(manifest, tall).select(
        "experiment_name", "status", "model_type", "embedding_prefix_dim", "class_imbalance_handling",
        "valid_f1_macro", "test_f1_macro",
    )
