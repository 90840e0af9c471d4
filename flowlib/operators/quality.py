"""Confusion counts and quality metrics.

Two conventions exist side by side. Model evaluation (``confusion_metrics``) gives 0.0 on an empty
denominator and rounds to 6 decimals; run evaluation (``prediction_quality``) gives null and does not round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlib.functions.text import format_fixed, model_label, split_label
from flowlib.functions.values import (
    collector_phase,
    first_numeric,
    in_phase,
    metric_phase,
    numeric_or_null,
    ratio_or_null,
    ratio_or_zero,
)

RATES = ("accuracy", "precision", "recall", "f1", "fpr", "fnr")

# Order of candidates and splits in the printed tables.
CANDIDATE_ORDER = ("LR-Full", "RF-Full", "GBT-Full", "RF-17")
SPLIT_ORDER = ("test_seen_temporal", "test_unseen_family", "test_rare_web")


def confusion_counts(label: Column, prediction: Column) -> list[Column]:
    pairs = {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}
    return [F.count_if((label == y) & (prediction == p)).alias(name) for name, (y, p) in pairs.items()]


def rates_or_zero(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Add the six rates of columns tp, tn, fp, fn; 0.0 where a denominator is empty."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    raw = df.withColumns({"_p": ratio_or_zero(tp, tp + fp), "_r": ratio_or_zero(tp, tp + fn)})
    total = F.col("_p") + F.col("_r")
    f1 = F.when(total > 0, 2.0 * F.col("_p") * F.col("_r") / total).otherwise(F.lit(0.0))
    values = {
        "accuracy": ratio_or_zero(tp + tn, tp + tn + fp + fn),
        "precision": F.col("_p"),
        "recall": F.col("_r"),
        "f1": f1,
        "fpr": ratio_or_zero(fp, fp + tn),
        "fnr": ratio_or_zero(fn, fn + tp),
    }
    return raw.withColumns({k: F.round(v, decimals) for k, v in values.items()}).drop("_p", "_r")


def confusion_metrics(df: DataFrame, keys: list[str], label: str = "label_binary", prediction: str = "prediction") -> DataFrame:
    """tp, tn, fp, fn, n and the six rates per group, in one pass."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"), *confusion_counts(F.col(label), F.col(prediction)))
    return rates_or_zero(counts)


def per_attack_recall(
    df: DataFrame, keys: list[str], label: str = "label_binary", prediction: str = "prediction", attack: str = "label"
) -> DataFrame:
    """Samples, detections and recall (6 decimals) of each attack type among true attacks."""
    attacks = df.where(F.col(label) == 1).groupBy(*keys, F.col(attack).alias("attack_type"))
    found = attacks.agg(F.count("*").alias("n_samples"), F.sum(F.col(prediction).cast("long")).alias("detected"))
    return found.withColumn("recall", F.round(F.col("detected") / F.col("n_samples"), 6))


def prediction_quality(preds: DataFrame, phase: str | None = "measure", runs: DataFrame | None = None) -> DataFrame:
    """Quality of each run's predictions in a phase, with a status.

    ``runs`` lists the runs to report; one without any prediction is ``quality_missing``. A run without rows
    in the phase is ``no_predictions``, one without a labelled prediction ``unlabeled``.
    """
    present = in_phase(preds, phase)
    y, p = numeric_or_null(preds, "label_binary"), numeric_or_null(preds, "prediction_label")
    score = numeric_or_null(preds, "prediction_score")
    rows = preds.select("run_tag", present.alias("_in"), y.alias("_y"), p.alias("_p"), score.alias("_s"))
    scored = F.col("_in") & F.col("_p").isNotNull()
    labeled = scored & F.col("_y").isNotNull()
    counts = rows.groupBy("run_tag").agg(
        F.count_if("_in").alias("_rows"),
        F.count_if(labeled).alias("labeled_rows_total"),
        F.count_if(scored).alias("scored_rows_total"),
        *[
            F.count_if(labeled & (F.col("_y").cast("int") == a) & (F.col("_p").cast("int") == b)).alias(name)
            for name, a, b in (("tp_total", 1, 1), ("tn_total", 0, 0), ("fp_total", 0, 1), ("fn_total", 1, 0))
        ],
        F.avg(F.when(scored, F.col("_s"))).alias("_score"),
        F.avg(F.when(labeled, F.col("_p").cast("int"))).alias("_attack"),
    )
    if runs is not None:
        counts = runs.select("run_tag").distinct().join(counts, "run_tag", "left")
    tp, tn, fp, fn = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp_total", "tn_total", "fp_total", "fn_total"))
    status = (
        F.when(F.col("_rows").isNull(), F.lit("quality_missing"))
        .when(F.col("_rows") == 0, F.lit("no_predictions"))
        .when(F.col("labeled_rows_total") == 0, F.lit("unlabeled"))
        .otherwise(F.lit("ok"))
    )
    rated = counts.select(
        "run_tag",
        status.alias("quality_status"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts.columns if c.endswith("_total")],
        ratio_or_null(tp, tp + fp).alias("precision"),
        ratio_or_null(tp, tp + fn).alias("recall"),
        ratio_or_null(fp, fp + tn).alias("fpr"),
        ratio_or_null(fn, fn + tp).alias("fnr"),
        F.when(F.col("labeled_rows_total") > 0, F.col("_score")).alias("avg_prediction_score_weighted"),
        F.when(F.col("labeled_rows_total") > 0, F.col("_attack")).alias("attack_ratio_weighted"),
    )
    total = F.col("precision") + F.col("recall")
    f1 = F.when(total > 0, 2.0 * F.col("precision") * F.col("recall") / total).when(total.isNotNull(), F.lit(0.0))
    return rated.withColumn("f1", f1)


def phase_counts(preds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows per collector phase."""
    keys = ["run_tag"] if keys is None else keys
    return preds.groupBy(*keys, collector_phase(F.col("benchmark_phase")).alias("phase")).agg(F.count("*").alias("actual"))


def row_barrier(preds: DataFrame, expected: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Actual against expected rows (columns keys, phase, expected); more rows than expected fail too."""
    keys = ["run_tag"] if keys is None else keys
    wanted = expected.groupBy(*keys, collector_phase(F.col("phase")).alias("phase")).agg(F.max("expected").alias("expected"))
    both = wanted.where("expected > 0").join(phase_counts(preds, keys), [*keys, "phase"], "left")
    actual = F.coalesce(F.col("actual"), F.lit(0))
    return both.select(
        *keys,
        "phase",
        "expected",
        actual.alias("actual"),
        (F.col("expected") - actual).alias("missing"),
        F.when(F.col("expected") == actual, F.lit("ok")).otherwise(F.lit("incomplete")).alias("status"),
    )


def artifact_row_barrier(preds: DataFrame, expected: DataFrame, phase: str) -> DataFrame:
    """Rows per run whose stored phase equals ``phase`` (missing is ``measure``) against ``expected`` (run_tag, expected)."""
    actual = preds.where(in_phase(preds, phase)).groupBy("run_tag").agg(F.count("*").alias("actual"))
    both = expected.join(actual, "run_tag", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return both.withColumn("status", F.when(F.col("expected") == F.col("actual"), F.lit("ok")).otherwise(F.lit("failed")))


def ordered_by(column: Column, order: tuple[str, ...]) -> Column:
    """Position of a value in ``order``; values it lacks are null."""
    out = None
    for i, value in enumerate(order):
        out = F.when(column == value, F.lit(i)) if out is None else out.when(column == value, F.lit(i))
    return out


def unseen_confusion_table(counts: DataFrame, reduced: str = "is_reduced", split: str = "test_unseen_family") -> DataFrame:
    """Attack recall and benign specificity of each candidate on the unseen families, as text; ``NA`` on an empty class."""
    attacks, benign = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    candidate = model_label(F.col("model"), F.col(reduced))
    return counts.where((F.col("split") == split) & candidate.isin(*CANDIDATE_ORDER)).select(
        candidate.alias("candidate"),
        *[F.col(c).cast("string").alias(c) for c in ("tn", "fp", "fn", "tp")],
        format_fixed(ratio_or_null(F.col("tp"), attacks), 4).alias("attack_recall"),
        format_fixed(ratio_or_null(F.col("tn"), benign), 4).alias("benign_specificity"),
    )


def calibration_table(metrics: DataFrame, reduced: str = "is_reduced") -> DataFrame:
    """Threshold and quality of each candidate, in the fixed candidate order (``position``)."""
    candidate = model_label(F.col("model"), F.col(reduced))
    threshold = first_numeric(metrics, "opt_threshold", "threshold")
    table = metrics.select(
        candidate.alias("candidate"),
        format_fixed(threshold, 4).alias("threshold"),
        *[format_fixed(numeric_or_null(metrics, c), 4).alias(c) for c in ("precision", "recall", "f1", "fpr")],
    )
    return table.withColumn("position", ordered_by(F.col("candidate"), CANDIDATE_ORDER)).orderBy(
        F.asc_nulls_last("position")
    )


def test_summary_table(summary: DataFrame, reduced: str = "is_reduced") -> DataFrame:
    """Quality per split and candidate, in the fixed split and candidate order."""
    table = summary.select(
        F.col("split").alias("_split"),
        split_label(F.col("split")).alias("split"),
        model_label(F.col("model"), F.col(reduced)).alias("candidate"),
        *[format_fixed(numeric_or_null(summary, c), 4).alias(c) for c in ("precision", "recall", "f1")],
    )
    placed = table.withColumns(
        {
            "split_position": ordered_by(F.col("_split"), SPLIT_ORDER),
            "candidate_position": ordered_by(F.col("candidate"), CANDIDATE_ORDER),
        }
    )
    return placed.drop("_split").orderBy(F.asc_nulls_last("split_position"), F.asc_nulls_last("candidate_position"))
