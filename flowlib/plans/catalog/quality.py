"""Quality, threshold and model choice queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlib.functions.values import apply_threshold
from flowlib.operators import quality, threshold
from flowlib.plans import views
from flowlib.plans.registry import query

RATES_SQL = """
  round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 0), 6) AS f1,
  round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) AS fnr"""
_COUNTS = """count(*) FILTER (label_binary = 1 AND prediction = 1) AS tp, count(*) FILTER (label_binary = 0 AND prediction = 0) AS tn,
  count(*) FILTER (label_binary = 0 AND prediction = 1) AS fp, count(*) FILTER (label_binary = 1 AND prediction = 0) AS fn"""


def _predicted(spark, sf):
    return views.scored(spark, sf).withColumn("prediction", apply_threshold(F.col("score"), 0.5))


_PREDICTED = "(SELECT *, (score >= 0.5)::INT AS prediction FROM scored) AS p"


@query("apply_threshold", sql="""
SELECT event_id, CASE WHEN prediction_score >= 0.25 AND event_id % 9 > 0 THEN 1 ELSE 0 END AS prediction FROM preds""")
def apply_threshold_query(spark, sf):
    score = F.expr("case when event_id % 9 > 0 then prediction_score end")
    return views.preds(spark, sf).select("event_id", apply_threshold(score, 0.25).alias("prediction"))


@query("confusion_metrics", sql=f"SELECT *, {RATES_SQL} FROM (SELECT model, split, count(*) AS n, {_COUNTS} FROM {_PREDICTED} GROUP BY 1, 2)")
def confusion_metrics(spark, sf):
    return quality.confusion_metrics(_predicted(spark, sf), ["model", "split"])


@query("label_pair_metrics", sql=f"""
SELECT *, {RATES_SQL} FROM (SELECT lang, count(*) AS n, {_COUNTS}
  FROM (SELECT lang, quality AS label_binary, toxic AS prediction FROM labels JOIN documents USING (doc_id)) GROUP BY 1)""")
def label_pair_metrics(spark, sf):
    rows = views.table(spark, sf, "labels").join(views.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return quality.confusion_metrics(rows, ["lang"], "quality", "toxic")


@query("per_attack_recall", sql="""
SELECT model, label AS attack_type, count(*) AS n_samples, sum(prediction)::BIGINT AS detected, round(sum(prediction) / count(*), 6) AS recall
FROM (SELECT model, label, (label <> 'N')::INT AS label_binary, (score >= 0.5)::INT AS prediction FROM scored) WHERE label_binary = 1 GROUP BY 1, 2""")
def per_attack_recall(spark, sf):
    rows = _predicted(spark, sf).withColumn("label_binary", F.expr("cast(label <> 'N' as int)"))
    return quality.per_attack_recall(rows, ["model"])


QUALITY_SQL = """
SELECT run_tag, CASE WHEN rows_in = 0 THEN 'no_predictions' WHEN labeled = 0 THEN 'unlabeled' ELSE 'ok' END AS quality_status,
  labeled AS labeled_rows_total, scored AS scored_rows_total, tp AS tp_total, tn AS tn_total, fp AS fp_total, fn AS fn_total,
  tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS fpr, fn / nullif(fn + tp, 0) AS fnr,
  CASE WHEN labeled > 0 THEN score END AS avg_prediction_score_weighted, CASE WHEN labeled > 0 THEN attack END AS attack_ratio_weighted,
  CASE WHEN tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0) > 0 THEN 2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / (tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0))
    WHEN tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0) IS NOT NULL THEN 0 END AS f1
FROM (SELECT run_tag, count(*) FILTER (i) AS rows_in, count(*) FILTER (i AND prediction_label IS NOT NULL) AS scored,
    count(*) FILTER (l) AS labeled, count(*) FILTER (l AND label_binary = 1 AND prediction_label = 1) AS tp,
    count(*) FILTER (l AND label_binary = 0 AND prediction_label = 0) AS tn, count(*) FILTER (l AND label_binary = 0 AND prediction_label = 1) AS fp,
    count(*) FILTER (l AND label_binary = 1 AND prediction_label = 0) AS fn,
    avg(prediction_score) FILTER (i AND prediction_label IS NOT NULL) AS score, avg(prediction_label) FILTER (l) AS attack
  FROM (SELECT *, i AND prediction_label IS NOT NULL AND label_binary IS NOT NULL AS l
    FROM (SELECT *, lower(coalesce(benchmark_phase, 'measure')) = '{phase}' AS i FROM preds)) GROUP BY 1)"""
QUALITY_FLOATS = "precision recall f1 fpr fnr avg_prediction_score_weighted attack_ratio_weighted"


@query("prediction_quality", sql=QUALITY_SQL.format(phase="measure"), floats=QUALITY_FLOATS)
def prediction_quality(spark, sf):
    return quality.prediction_quality(views.preds(spark, sf), "measure")


@query("prediction_quality_warmup", sql=QUALITY_SQL.format(phase="warmup"), floats=QUALITY_FLOATS)
def prediction_quality_warmup(spark, sf):
    return quality.prediction_quality(views.preds(spark, sf), "Warmup", views.base_runs(spark, sf))


@query("phase_counts", sql="""
SELECT run_tag, CASE WHEN lower(trim(benchmark_phase)) IN ('warmup', 'cold_start', 'pre_fault', 'post_fault') THEN lower(trim(benchmark_phase)) ELSE 'measure' END AS phase, count(*) AS actual
FROM preds GROUP BY 1, 2""")
def phase_counts(spark, sf):
    return quality.phase_counts(views.preds(spark, sf))


@query("row_barrier", sql="""
WITH a AS (SELECT run_tag, CASE WHEN lower(trim(benchmark_phase)) IN ('warmup', 'cold_start', 'pre_fault', 'post_fault') THEN lower(trim(benchmark_phase)) ELSE 'measure' END AS phase, count(*) AS actual FROM preds GROUP BY 1, 2),
 e AS (SELECT run_tag, phase, CASE WHEN repeat_index % 2 = 0 THEN coalesce(actual, 7) ELSE coalesce(actual, 0) + repeat_index - 2 END AS expected
   FROM base_runs CROSS JOIN (VALUES ('measure'), ('warmup')) p(phase) LEFT JOIN a USING (run_tag, phase))
SELECT run_tag, phase, expected, coalesce(actual, 0) AS actual, expected - coalesce(actual, 0) AS missing, CASE WHEN expected = coalesce(actual, 0) THEN 'ok' ELSE 'incomplete' END AS status
FROM e LEFT JOIN a USING (run_tag, phase) WHERE expected > 0""")
def row_barrier(spark, sf):
    preds = views.preds(spark, sf)
    counts = quality.phase_counts(preds)
    wanted = views.base_runs(spark, sf).select("run_tag", "repeat_index", F.explode(F.array(F.lit("measure"), F.lit("warmup"))).alias("phase"))
    expected = wanted.join(counts, ["run_tag", "phase"], "left").selectExpr(
        "run_tag", "phase", "case when repeat_index % 2 = 0 then coalesce(actual, 7) else coalesce(actual, 0) + repeat_index - 2 end as expected"
    )
    return quality.row_barrier(preds, expected)


@query("artifact_row_barrier", sql="""
SELECT run_tag, rows_expected AS expected, coalesce(actual, 0) AS actual, CASE WHEN rows_expected = coalesce(actual, 0) THEN 'ok' ELSE 'failed' END AS status
FROM base_runs LEFT JOIN (SELECT run_tag, count(*) AS actual FROM preds WHERE lower(coalesce(benchmark_phase, 'measure')) = 'measure' GROUP BY 1) USING (run_tag)""")
def artifact_row_barrier(spark, sf):
    expected = views.base_runs(spark, sf).selectExpr("run_tag", "rows_expected as expected")
    return quality.artifact_row_barrier(views.preds(spark, sf), expected, "measure")


_AUC = """
SELECT model, greatest(0, least(1, (sum(rk) FILTER (label_binary = 1) - any_value(p) * (any_value(p) + 1) / 2.0::DOUBLE) / (any_value(p)::DOUBLE * any_value(q)))) AS roc_auc
FROM (SELECT model, label_binary, rank() OVER w + (count(*) OVER (PARTITION BY model, {s}) - 1) / 2.0::DOUBLE AS rk,
    count(*) FILTER (label_binary = 1) OVER (PARTITION BY model) AS p, count(*) FILTER (label_binary = 0) OVER (PARTITION BY model) AS q
  FROM scored WINDOW w AS (PARTITION BY model ORDER BY {s})) GROUP BY 1"""


@query("roc_auc", sql=_AUC.format(s="score"), floats="roc_auc")
def roc_auc(spark, sf):
    return threshold.roc_auc(views.scored(spark, sf), ["model"])


@query("roc_auc_untied", sql=_AUC.format(s="raw_score"), floats="roc_auc")
def roc_auc_untied(spark, sf):
    return threshold.roc_auc(views.scored(spark, sf, rounded=False), ["model"])


_THRESHOLDS = """
SELECT model, budget, min(score) FILTER (pos > 0 AND neg_from / n_neg <= budget) AS threshold FROM (
  SELECT model, score, pos, sum(neg) OVER (PARTITION BY model ORDER BY score DESC) AS neg_from, sum(neg) OVER (PARTITION BY model) AS n_neg
  FROM (SELECT model, {s} AS score, count(*) FILTER (label_binary = 1) AS pos, count(*) FILTER (label_binary = 0) AS neg FROM scored GROUP BY 1, 2)
) CROSS JOIN (VALUES (0.01::DOUBLE), (0.03::DOUBLE), (0.05::DOUBLE), (0.10::DOUBLE)) b(budget) GROUP BY 1, 2"""


@query("threshold_for_fpr_budget", sql=f"SELECT model, threshold FROM ({_THRESHOLDS.format(s='score')}) AS t WHERE budget = 0.03")
def threshold_for_fpr_budget(spark, sf):
    return threshold.threshold_for_fpr_budget(views.scored(spark, sf), ["model"])


@query("threshold_untied", sql=f"SELECT model, threshold FROM ({_THRESHOLDS.format(s='raw_score')}) AS t WHERE budget = 0.03")
def threshold_untied(spark, sf):
    return threshold.threshold_for_fpr_budget(views.scored(spark, sf, rounded=False), ["model"])


POINTS_SQL = f"""
SELECT model, point, threshold, tp, fp, fn, tn, round(roc_auc, 6) AS roc_auc, {RATES_SQL} FROM (
  SELECT model, point, threshold, {_COUNTS} FROM (SELECT t.model, point, threshold, label_binary, (score >= threshold)::INT AS prediction
    FROM (SELECT model, 'fpr_'||round(budget * 100)::INT||'pct' AS point, threshold FROM ({_THRESHOLDS.format(s='score')}) AS x
      UNION ALL SELECT DISTINCT model, 'default_0.5', 0.5::DOUBLE FROM scored) t JOIN scored USING (model)) GROUP BY 1, 2, 3) JOIN ({_AUC.format(s='score')}) AS u USING (model)"""


@query("operating_points", sql=POINTS_SQL)
def operating_points(spark, sf):
    return threshold.operating_points(views.scored(spark, sf), ["model"])


def _history(spark, sf):
    """Quality of every return flag's scores, as if each were a model."""
    rows = _predicted(spark, sf).withColumn("model", F.concat("model", F.lit("_"), F.col("label")))
    rows = rows.withColumn("label_binary", F.expr("cast(cast(round(score * 10000) as bigint) % 3 = 1 as int)"))
    return quality.confusion_metrics(rows, ["model"])


_HISTORY = f"""SELECT *, {RATES_SQL} FROM (SELECT model, count(*) AS n, {_COUNTS} FROM (SELECT model||'_'||label AS model,
  (round(score * 10000)::BIGINT % 3 = 1)::INT AS label_binary, (score >= 0.5)::INT AS prediction FROM scored) GROUP BY 1)"""


@query("select_best_model", sql=f"{_HISTORY} ORDER BY recall DESC, fpr, precision DESC, model LIMIT 1")
def select_best_model(spark, sf):
    return threshold.select_best_model(_history(spark, sf))


def _candidates(spark, sf):
    """Confusion metrics per (model name, split, feature set) of the shared predictions."""
    rows = views.preds(spark, sf).dropna(subset=["prediction_label", "label_binary"])
    rows = rows.withColumns(
        {
            "model": F.expr("element_at(array('logistic_regression', 'random_forest', 'gradient_boosting'), cast(event_id % 3 + 1 as int))"),
            "split": F.expr("element_at(array('test_seen_temporal', 'test_unseen_family', 'test_rare_web'), cast(event_id % 7 % 3 + 1 as int))"),
            "is_reduced": F.expr("event_id % 2 = 0 and event_id % 3 = 1"),
        }
    )
    return quality.confusion_metrics(rows, ["model", "split", "is_reduced"], prediction="prediction_label")


_CANDIDATES = f"""SELECT *, {RATES_SQL}, CASE WHEN is_reduced THEN 'RF-17' ELSE (['LR-Full', 'RF-Full', 'GBT-Full'])[m + 1] END AS candidate FROM (
  SELECT m, (['test_seen_temporal', 'test_unseen_family', 'test_rare_web'])[s + 1] AS split, is_reduced, count(*) AS n, {_COUNTS}
  FROM (SELECT event_id % 3 AS m, event_id % 7 % 3 AS s, event_id % 2 = 0 AND event_id % 3 = 1 AS is_reduced, label_binary, prediction_label AS prediction
    FROM preds WHERE prediction_label IS NOT NULL AND label_binary IS NOT NULL) GROUP BY 1, 2, 3)"""


@query("unseen_confusion_table", sql=f"""
SELECT candidate, tn::VARCHAR AS tn, fp::VARCHAR AS fp, fn::VARCHAR AS fn, tp::VARCHAR AS tp, coalesce(printf('%.4f', tp / nullif(tp + fn, 0)), 'NA') AS attack_recall,
  coalesce(printf('%.4f', tn / nullif(tn + fp, 0)), 'NA') AS benign_specificity FROM ({_CANDIDATES}) AS c WHERE split = 'test_unseen_family'""")
def unseen_confusion_table(spark, sf):
    return quality.unseen_confusion_table(_candidates(spark, sf))


_POSITION = "CASE candidate WHEN 'LR-Full' THEN 0 WHEN 'RF-Full' THEN 1 WHEN 'GBT-Full' THEN 2 WHEN 'RF-17' THEN 3 END"


@query("calibration_table", sql=f"""
SELECT candidate, printf('%.4f', threshold) AS threshold, printf('%.4f', precision) AS precision, printf('%.4f', recall) AS recall, printf('%.4f', f1) AS f1,
  printf('%.4f', fpr) AS fpr, {_POSITION} AS position
FROM (SELECT *, CASE model WHEN 'm0' THEN 'LR-Full' ELSE 'RF-Full' END AS candidate FROM ({POINTS_SQL}) AS x WHERE point = 'fpr_3pct') AS c""")
def calibration_table(spark, sf):
    """Thresholds chosen on the calibration split under the primary budget."""
    points = threshold.operating_points(views.scored(spark, sf).where("split = 'calibration'"), ["model"]).where("point = 'fpr_3pct'")
    code = F.expr("case model when 'm0' then 'logistic_regression' else 'random_forest' end")
    return quality.calibration_table(points.withColumns({"model": code, "is_reduced": F.lit(False), "opt_threshold": F.col("threshold")}))


@query("test_summary_table", sql=f"""
SELECT CASE split WHEN 'test_seen_temporal' THEN 'Test theo thời gian' WHEN 'test_unseen_family' THEN 'Test họ mới' ELSE 'Test Web hiếm' END AS split, candidate,
  printf('%.4f', precision) AS precision, printf('%.4f', recall) AS recall, printf('%.4f', f1) AS f1,
  CASE split WHEN 'test_seen_temporal' THEN 0 WHEN 'test_unseen_family' THEN 1 ELSE 2 END AS split_position, {_POSITION} AS candidate_position FROM ({_CANDIDATES}) AS c""")
def test_summary_table(spark, sf):
    return quality.test_summary_table(_candidates(spark, sf))


@query("custom_order", sql=f"""
SELECT candidate, split, row_number() OVER (ORDER BY {_POSITION}, recall DESC, split)::INT AS place, recall FROM ({_CANDIDATES}) AS c""")
def custom_order(spark, sf):
    from flowlib.functions.text import model_label

    rows = _candidates(spark, sf).withColumn("candidate", model_label(F.col("model"), F.col("is_reduced")))
    ranked = rows.withColumn("position", quality.ordered_by(F.col("candidate"), quality.CANDIDATE_ORDER))
    return ranked.select("candidate", "split", F.expr("row_number() over (order by position, recall desc, split) as place"), "recall")
