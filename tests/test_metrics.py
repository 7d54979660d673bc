import numpy as np
import pytest
from pyspark.sql import functions as F

from relvec.functions import probabilities as P
from relvec.operators import calibration as C
from relvec.operators import metrics as M
from relvec.operators.ordered import running_sums

EPS = 1.1920929e-07


def frame(spark, y, probs, split="s", weight=None):
    rows = [(split, int(a), [float(x) for x in p], 1.0 if weight is None else float(weight[i])) for i, (a, p) in enumerate(zip(y, probs))]
    return spark.createDataFrame(rows, "split string, label_id int, probs array<double>, w double")


def sample(n=400, k=4, seed=0, ties=True):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    raw = rng.random((n, k)) + 0.4 * np.eye(k)[y]
    if ties:
        raw = np.ceil(raw * 8)
    return y, raw / raw.sum(1, keepdims=True), rng.random(n) + 0.1


def auc(hit, score, w):
    order = np.subtract.outer(score[hit], score[~hit])
    pairs = np.multiply.outer(w[hit], w[~hit])
    return float((((order > 0) + 0.5 * (order == 0)) * pairs).sum() / pairs.sum())


def average_precision(hit, score, w):
    total, last, out = w[hit].sum(), 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        at = score >= t
        recall, precision = w[at & hit].sum() / total, w[at & hit].sum() / w[at].sum()
        out += (recall - last) * precision
        last = recall
    return out


def expected(y, p, w):
    k = p.shape[1]
    pred = p.argmax(1)
    tp = np.array([w[(y == c) & (pred == c)].sum() for c in range(k)])
    sup = np.array([w[y == c].sum() for c in range(k)])
    pre = np.array([w[pred == c].sum() for c in range(k)])
    seen = np.array([(y == c).any() or (pred == c).any() for c in range(k)])
    div = lambda a, b: np.divide(a, b, out=np.zeros(k), where=b > 0)
    recall, precision, f1 = div(tp, sup), div(tp, pre), div(2 * tp, sup + pre)
    out = {
        "logloss": float((w * -np.log(np.clip(p[np.arange(len(y)), y], EPS, 1 - EPS))).sum() / w.sum()),
        "accuracy": tp.sum() / w.sum(), "balanced_accuracy": recall[sup > 0].mean(), "precision_macro": precision[seen].mean(),
        "recall_macro": recall[seen].mean(), "f1_macro": f1[seen].mean(), "f1_weighted": (f1 * sup).sum() / sup.sum(),
    }
    classes = [1] if k == 2 else range(k)
    defined = all((y == c).any() and (y != c).any() for c in classes)
    out["roc_auc_ovr_macro"] = np.mean([auc(y == c, p[:, c], w) for c in classes]) if defined else None
    out["pr_auc_ovr_macro"] = np.mean([average_precision(y == c, p[:, c], w) if (y == c).any() else 0.0 for c in classes])
    return out


def check(row, want):
    for name, value in want.items():
        if value is None:
            assert row[name] is None, name
        else:
            assert row[name] == pytest.approx(value, abs=2e-6), name


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("k", [2, 4])
def test_metrics_match_numpy(spark, weighted, k):
    y, p, w = sample(k=k)
    row = M.evaluate_wide(frame(spark, y, p, weight=w), k, weight="w" if weighted else None).first()
    check(row, expected(y, p, w if weighted else np.ones(len(y))))
    assert row["count"] == 400 and row["num_classes"] == k


def test_absent_classes(spark):
    """Class 2 is never true, class 3 is never true nor predicted."""
    y = np.array([0, 0, 1, 1])
    p = np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1], [0.1, 0.7, 0.1, 0.1], [0.4, 0.3, 0.2, 0.1]])
    row = M.evaluate_wide(frame(spark, y, p), 4).first()
    check(row, expected(y, p, np.ones(4)))
    assert row.roc_auc_ovr_macro is None


def test_first_maximum_wins(spark):
    df = frame(spark, [1], [[0.2, 0.4, 0.4]])
    assert M.scored(df).first().predicted_id == 1


def test_confusion_matrix_keeps_empty_cells_and_totals(spark):
    y, p, _ = sample()
    cells = M.confusion_matrix(frame(spark, y, p), 4)
    assert cells.count() == 16 and cells.agg(F.sum("n")).first()[0] == 400


def test_area_ignores_monotone_transforms(spark):
    y, p, _ = sample(ties=False)
    df = frame(spark, y, p)
    squared = df.withColumn("probs", F.transform("probs", lambda x: x * x * x))
    assert M.macro_areas(df, 4).collect() == M.macro_areas(squared, 4).collect()


@pytest.mark.parametrize("window", [7, 50, 10**6])
@pytest.mark.parametrize("descending", [True, False])
def test_running_sums_do_not_depend_on_buckets(spark, window, descending):
    rng = np.random.default_rng(5)
    rows = [(g, float(s), int(v)) for g in "ab" for s, v in zip(rng.permutation(200) ** 2 / 7.0, rng.integers(0, 9, 200))]
    df = spark.createDataFrame(rows, "g string, score double, v int")
    got = running_sums(df, ["g"], "score", ["v"], descending, window).collect()
    for g in "ab":
        total = 0
        for _, s, v in sorted((r for r in rows if r[0] == g), key=lambda r: -r[1] if descending else r[1]):
            total += v
            assert [r.cum_v for r in got if r.g == g and r.score == s] == [total]


def test_equal_scores_everywhere(spark):
    df = spark.createDataFrame([("a", 0.5, 3)] + [("b", 0.5, 4)], "g string, score double, v int")
    assert {r.g: r.cum_v for r in running_sums(df, ["g"], "score", ["v"], rows_per_window=1).collect()} == {"a": 3, "b": 4}


def test_calibration_matches_numpy(spark):
    y, p, _ = sample(n=501, ties=False)
    conf, hit = p.max(1), p.argmax(1) == y
    edges = np.quantile(conf, np.linspace(0, 1, 11))
    ids = np.digitize(conf, edges[1:-1], right=True)
    got = {r.bin: r for r in C.calibration_bins(frame(spark, y, p)).collect()}
    assert sorted(got) == sorted(set(ids))
    for b in got:
        assert got[b].n == (ids == b).sum()
        assert got[b].mean_confidence == pytest.approx(conf[ids == b].mean(), abs=1e-6)
        assert got[b].accuracy == pytest.approx(hit[ids == b].mean(), abs=1e-6)


def test_histogram_matches_numpy(spark):
    y, p, _ = sample(n=300)
    conf, hit = p.max(1), p.argmax(1) == y
    got = C.confidence_histogram(frame(spark, y, p)).collect()
    for flag in (True, False):
        counts, _ = np.histogram(conf[hit == flag], bins=40)
        assert {r.bin: r.n for r in got if r.correct == flag} == {i: c for i, c in enumerate(counts) if c}


def test_histogram_of_one_value(spark):
    got = C.confidence_histogram(frame(spark, [0, 0], [[0.75, 0.25]] * 2)).collect()
    assert [(r.bin, r.n, r.left_edge) for r in got] == [(20, 2, 0.75)]


def test_curves_run_from_corner_to_corner(spark):
    y, p, _ = sample()
    df = frame(spark, y, p)
    roc = M.roc_curve_micro(df, 4).orderBy("fpr", "tpr").collect()
    assert (roc[0].fpr, roc[0].tpr, roc[-1].fpr, roc[-1].tpr) == (0.0, 0.0, 1.0, 1.0)
    hit, score = np.eye(4)[y].astype(bool).ravel(), p.ravel()
    assert roc[0].auc == pytest.approx(auc(hit, score, np.ones(len(score))), abs=1e-6)
    pr = M.pr_curve_micro(df, 4).orderBy("recall").collect()
    assert (pr[0].recall, pr[0].precision) == (0.0, 1.0) and pr[-1].recall == 1.0
    assert pr[0].average_precision == pytest.approx(average_precision(hit, score, np.ones(len(score))), abs=1e-6)


def test_cross_entropy_and_softmax(spark):
    df = frame(spark, [0, 1], [[0.5, 0.5], [0.2, 0.8]], weight=[1.0, 3.0])
    want = (-np.log(0.5) - 3 * np.log(0.8)) / 4
    assert M.weighted_cross_entropy(df, weight="w").first().cross_entropy == pytest.approx(want, abs=1e-6)
    out = df.select(P.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("p")).first().p
    assert list(out) == [0.5, 0.5]
    assert list(df.select(P.two_class(F.lit(0.25)).alias("p")).first().p) == [0.75, 0.25]


def test_log_loss_clips(spark):
    row = M.evaluate_wide(frame(spark, [0, 1], [[0.0, 1.0], [0.0, 1.0]]), 2).first()
    assert row.logloss == pytest.approx((-np.log(EPS) - np.log(1 - EPS)) / 2, abs=1e-6)


def test_evaluations_need_a_key(spark):
    with pytest.raises(ValueError, match="at least one column"):
        M.evaluate_wide(frame(spark, [0, 1], [[0.5, 0.5]] * 2), 2, by=[])


def test_tall_and_wide_agree(spark):
    y, p, _ = sample()
    wide = M.evaluate_wide(frame(spark, y, p), 4)
    back = M.to_wide(M.to_tall(wide)).first().asDict()
    assert {k: v for k, v in wide.first().asDict().items() if k != "split"} == {k: v for k, v in back.items() if k != "split"}


def test_points_are_not_joined_by_split_alone(spark):
    """A split that holds all points must be no join key of theirs."""
    rows = spark.range(400).select(F.lit("train").alias("split"), (F.col("id") % 3).cast("int").alias("label_id"), F.array(
        *[((F.col("id") * m) % 97 / 97.0) for m in (3, 5, 7)]).alias("probs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (M.roc_curve_micro(rows, 3), M.pr_curve_micro(rows, 3), C.calibration_bins(rows)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            keys = [line.split("SortMergeJoin ")[1] for line in plan.splitlines() if "SortMergeJoin " in line]
            assert any("_range" in k.split("]")[0] for k in keys), keys
            assert out.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
