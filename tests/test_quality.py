from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlib.operators import quality, threshold
from tests.conftest import rows


def scored(spark, labels, scores, model="m"):
    return spark.createDataFrame([(model, int(y), float(s)) for y, s in zip(labels, scores)], "model string, label_binary int, score double")


def closed_form(labels, scores, budget):
    """Whole tie groups: lowest positive score whose false-positive share stays within the budget."""
    pos, neg = sum(labels), len(labels) - sum(labels)
    if not pos or not neg:
        return 0.5
    share = lambda t: sum(1 for y, s in zip(labels, scores) if not y and s >= t) / neg
    good = [s for y, s in zip(labels, scores) if y and share(s) <= budget]
    top = max(scores)
    return min(good) if good else (top if share(top) <= budget else math.nextafter(top, math.inf))


def pair_auc(labels, scores):
    pairs = [(p, n) for (y, p), (z, n) in itertools.product(zip(labels, scores), repeat=2) if y and not z]
    return sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs) if pairs else 0.0


def test_small_auc(spark):
    df = scored(spark, [1, 0, 1, 0, 0, 1], [0.9, 0.9, 0.4, 0.4, 0.1, 0.8])
    assert threshold.roc_auc(df, ["model"]).first().roc_auc == pytest.approx(2 / 3)


@pytest.mark.parametrize("labels, scores", [([1, 1], [0.2, 0.3]), ([0, 0], [0.2, 0.3])])
def test_single_class(spark, labels, scores):
    df = scored(spark, labels, scores)
    assert threshold.roc_auc(df, ["model"]).first().roc_auc == 0.0
    assert threshold.threshold_for_fpr_budget(df, ["model"], 0.03).first().threshold == 0.5


def test_no_admissible_prefix_goes_above_the_top(spark):
    df = scored(spark, [0, 1, 1, 0], [0.9, 0.5, 0.4, 0.1])
    assert threshold.threshold_for_fpr_budget(df, ["model"], 0.01).first().threshold == math.nextafter(0.9, math.inf)


def test_a_tie_group_is_taken_whole(spark):
    # A row-wise cut could stop inside the tie at 0.7 and break the budget when applied.
    df = scored(spark, [1, 1, 0, 0, 0, 0], [0.9, 0.7, 0.7, 0.7, 0.2, 0.1])
    assert threshold.threshold_for_fpr_budget(df, ["model"], 0.25).first().threshold == 0.9


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(-3, 13)), min_size=2, max_size=60), st.sampled_from([0.01, 0.1, 0.34, 0.5]))
def test_threshold_and_auc_match_brute_force(spark, cells, budget):
    labels, scores = [y for y, _ in cells], [s / 10 for _, s in cells]
    df = scored(spark, labels, scores)
    found = threshold.thresholds_for_budgets(threshold.score_table(df, ["model"]), ["model"], (budget,)).first()
    t = found[threshold.budget_name(budget)]
    assert t == closed_form(labels, scores, budget)
    assert found.roc_auc == pytest.approx(pair_auc(labels, scores))
    negatives = labels.count(0)
    if negatives and 1 in labels:
        assert sum(1 for y, s in zip(labels, scores) if not y and s >= t) / negatives <= budget


def test_score_table_of_null_and_missing_groups(spark):
    df = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.1), ("a", 0, 0.9), ("a", 1, 0.1)], "model string, label_binary int, score double")
    assert {r.model: r.roc_auc for r in threshold.roc_auc(df, ["model"]).collect()} == {None: 1.0, "a": 0.0}
    assert threshold.roc_auc(df, []).first().roc_auc == 0.5


def test_join_and_window_of_scores_share_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = scored(spark, [1, 0], [0.9, 0.1])
        plan = threshold.score_table(df, ["model"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    window, join = plan.index("Window [sum(neg"), plan.index("SortMergeJoin")
    assert window < join and "Exchange" not in plan[window:join]


def test_continuous_scores_on_both_ends(spark):
    rng = np.random.default_rng(5)
    scores = 1 / (1 + np.exp(-rng.normal(0, 6, 4000)))
    labels = (rng.random(4000) < scores).astype(int)
    table = {r.score: r.neg_from for r in threshold.score_table(scored(spark, labels, scores), ["model"]).collect()}
    order = np.argsort(-scores)
    running = dict(zip(scores[order].tolist(), np.cumsum(labels[order] == 0).tolist()))
    assert table == running


def test_operating_points_count_like_confusion_metrics(spark):
    rng = random.Random(2)
    cells = [(rng.randrange(2), rng.randrange(50) / 50) for _ in range(500)]
    df = scored(spark, [y for y, _ in cells], [s for _, s in cells])
    points = threshold.operating_points(df, ["model"]).collect()
    assert {p.point for p in points} == {"fpr_1pct", "fpr_3pct", "fpr_5pct", "fpr_10pct", "default_0.5"}
    for p in points:
        direct = quality.confusion_metrics(df.withColumn("prediction", F.expr(f"cast(score >= {p.threshold!r}D as int)")), ["model"]).first()
        assert (p.tp, p.tn, p.fp, p.fn, p.f1, p.fpr) == (direct.tp, direct.tn, direct.fp, direct.fn, direct.f1, direct.fpr)


def test_zero_denominators_offline(spark):
    df = spark.createDataFrame([("m", 0, 0)], "model string, label_binary int, prediction int")
    got = quality.confusion_metrics(df, ["model"]).first()
    assert (got.accuracy, got.precision, got.recall, got.f1, got.fpr, got.fnr) == (1.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_run_quality_statuses(spark):
    schema = "run_tag string, benchmark_phase string, label_binary int, prediction_label int, prediction_score double"
    preds = spark.createDataFrame(
        [
            ("ok", None, 1, 1, 0.9), ("ok", "MEASURE", 0, 1, 0.5), ("ok", "measure", 1, 0, 0.1), ("ok", "measure", None, 1, 0.5), ("ok", "measure", 1, None, 0.7), ("ok", "warmup", 1, 1, 0.9),
            ("late", "warmup", 1, 1, 0.9), ("bare", "measure", None, 1, 0.4), ("none", "measure", 0, 0, 0.1),
        ],
        schema,
    )
    runs = spark.createDataFrame([("ok",), ("late",), ("bare",), ("gone",), ("none",)], "run_tag string")
    got = {r.run_tag: r for r in quality.prediction_quality(preds, "measure", runs).collect()}
    assert {k: v.quality_status for k, v in got.items()} == {"ok": "ok", "late": "no_predictions", "bare": "unlabeled", "gone": "quality_missing", "none": "ok"}
    ok = got["ok"]
    assert (ok.labeled_rows_total, ok.scored_rows_total, ok.tp_total, ok.fp_total, ok.fn_total) == (3, 4, 1, 1, 1)
    assert (ok.precision, ok.recall, ok.fpr, ok.f1) == (0.5, 0.5, 1.0, 0.5)
    assert ok.avg_prediction_score_weighted == pytest.approx(0.5) and ok.attack_ratio_weighted == pytest.approx(2 / 3)
    assert got["bare"].scored_rows_total == 1 and got["bare"].avg_prediction_score_weighted is None
    assert (got["none"].precision, got["none"].recall, got["none"].f1, got["none"].fpr) == (None, None, None, 0.0)


def test_row_barrier_fails_on_too_many(spark):
    preds = spark.createDataFrame([("r", "measure")] * 3 + [("r", "Warmup ")], "run_tag string, benchmark_phase string")
    expected = spark.createDataFrame([("r", "measure", 2), ("r", "warmup", 1), ("r", "pre_fault", 4), ("r", "post_fault", 0)], "run_tag string, phase string, expected int")
    got = {r.phase: (r.actual, r.missing, r.status) for r in quality.row_barrier(preds, expected).collect()}
    assert got == {"measure": (3, -1, "incomplete"), "warmup": (1, 0, "ok"), "pre_fault": (0, 4, "incomplete")}


def test_best_model_order(spark):
    df = spark.createDataFrame([("a", 0.9, 0.2, 0.5), ("b", 0.9, 0.1, 0.4), ("c", 0.9, 0.1, 0.6), ("d", 0.8, 0.0, 0.9)], "model string, recall double, fpr double, precision double")
    assert rows(threshold.select_best_model(df).select("model")) == [("c",)]


def test_tables_print_na_and_keep_order(spark):
    df = spark.createDataFrame(
        [("gradient_boosting", False, 0.5, 0.1), ("random_forest", True, 0.25, None), ("logistic_regression", False, None, 0.3), ("random_forest", False, 0.7, 0.4)],
        "model string, is_reduced boolean, opt_threshold double, precision double",
    )
    got = [(r.candidate, r.threshold, r.precision, r.recall) for r in quality.calibration_table(df).collect()]
    assert got == [("LR-Full", "NA", "0.3000", "NA"), ("RF-Full", "0.7000", "0.4000", "NA"), ("GBT-Full", "0.5000", "0.1000", "NA"), ("RF-17", "0.2500", "NA", "NA")]
