"""Offline experiment: fit each model, calibrate, evaluate every test split, keep history, pick the best."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlib.operators.ml import FittedModel, ModelSpec, fill_values, fit_model, score_batch, with_class_weight
from flowlib.operators.quality import confusion_metrics, per_attack_recall
from flowlib.operators.summary import upsert_summary
from flowlib.operators.threshold import (
    FPR_BUDGETS,
    PRIMARY_FPR_BUDGET,
    budget_name,
    operating_points,
    predict_at,
    roc_auc,
    select_best_model,
)
from flowlib.scratch import small_side, stored
from flowlib.sources.tables import modeling_frame, save_scored_split


@dataclass(frozen=True)
class ExperimentConfig:
    feature_set: str
    features: list[str]
    models: list[ModelSpec]
    root: str
    strategy: str = "median"
    use_class_weight: bool = True
    label: str = "label_binary"
    attack_label: str = "label"
    budgets: tuple[float, ...] = FPR_BUDGETS
    primary_budget: float = PRIMARY_FPR_BUDGET
    run_version: int = 0


@dataclass
class ExperimentResult:
    fitted: list[FittedModel] = field(default_factory=list)
    points: DataFrame | None = None
    validation: DataFrame | None = None
    test_summary: DataFrame | None = None
    per_attack: DataFrame | None = None
    best: DataFrame | None = None
    manifest: DataFrame | None = None


def _scored_path(config: ExperimentConfig) -> str:
    """A folder per run: result tables are lazy and must not see a later run's files."""
    return f"{config.root}/scored/run={config.run_version}"


def run_experiment(
    spark: SparkSession, config: ExperimentConfig, train: DataFrame, calibration: DataFrame, tests: dict[str, DataFrame],
    history: DataFrame | None = None,
) -> ExperimentResult:
    """Fit, calibrate and evaluate; every table of the result is a DataFrame, no scored row reaches the driver.

    Scored rows are written once per (model, split); thresholds and metrics of all models then come from
    grouped passes over that table.
    """
    out = ExperimentResult()
    fit_rows = modeling_frame(train, config.features, config.label)
    weighted = with_class_weight(fit_rows, config.label) if config.use_class_weight else fit_rows
    weight = "class_weight" if config.use_class_weight else None
    splits = {"calibration": calibration, **tests}
    for spec in config.models:
        fitted = fit_model(
            weighted, config.features, spec, f"{config.root}/models/{spec.name}", strategy=config.strategy, label=config.label, weight=weight
        )
        out.fitted.append(fitted)
        for split, rows in splits.items():
            frame = modeling_frame(rows, config.features, config.label, config.attack_label)
            scored = score_batch(fitted.model, frame, label=config.label, attack_label=config.attack_label)
            save_scored_split(scored, _scored_path(config), spec.name, split)
    names = [s.name for s in config.models]
    scored = spark.read.parquet(_scored_path(config)).where(F.col("model").isin(names) & F.col("split").isin(list(splits)))

    # Every later table starts from these small stored ones, so scored rows are read once per metric.
    out.points = stored(operating_points(scored.where("split = 'calibration'"), ["model"], config.budgets, config.label), "points")
    primary = out.points.where(F.col("point") == budget_name(config.primary_budget))
    thresholds = small_side(primary.select("model", "threshold"))
    predicted = predict_at(scored, thresholds, ["model"])
    quality = confusion_metrics(predicted, ["model", "split"], config.label)
    aucs = roc_auc(scored, ["model", "split"], config.label).withColumn("roc_auc", F.round("roc_auc", 6))
    timing = spark.createDataFrame([(f.spec.name, round(f.train_time_s, 2), f.path) for f in out.fitted], "model string, train_time_s double, model_path string")
    summary = stored(
        quality.join(aucs, ["model", "split"])
        .join(F.broadcast(timing), "model")
        .join(thresholds.withColumnRenamed("threshold", "opt_threshold"), "model")
        .withColumns({"fpr_budget": F.lit(config.primary_budget), "version": F.lit(config.run_version)}),
        "experiment-summary",
    )
    default = out.points.where("point = 'default_0.5'").select(
        "model", *[F.col(c).alias(f"default_{c}") for c in ("recall", "precision", "f1", "fpr")]
    )
    current = summary.where("split = 'calibration'").join(default, "model").withColumns(
        {"class_weight": F.lit(config.use_class_weight), "default_threshold": F.lit(0.5)}
    )
    out.validation = upsert_summary(history, current, ["model", "split"], [F.desc("recall"), F.asc("fpr"), F.desc("precision")])
    out.test_summary = summary.where("split <> 'calibration'").orderBy("split", F.desc("recall"), "fpr")
    out.per_attack = per_attack_recall(predicted, ["model", "split"], config.label, attack=config.attack_label).join(
        thresholds.withColumn("threshold", F.round("threshold", 6)), "model"
    )
    out.best = select_best_model(out.validation)
    out.manifest = out.best.select(
        F.lit(config.feature_set).alias("feature_set"),
        F.lit(config.label).alias("target_column"),
        F.array(*[F.lit(c) for c in config.features]).alias("feature_columns"),
        F.lit(len(config.features)).alias("n_features"),
        F.lit(config.strategy).alias("impute_strategy"),
        "model", "model_path", "opt_threshold", "fpr_budget",
        F.lit(f"recall@FPR<={int(config.primary_budget * 100)}%").alias("selection_metric"),
    )
    return out


def write_results(result: ExperimentResult, config: ExperimentConfig) -> None:
    """Result tables next to the models, each replaced as a whole."""
    tables = {
        "operating_points": result.points,
        "test_summary": result.test_summary,
        "per_attack_recall": result.per_attack,
        "best_model": result.best,
        "feature_manifest": result.manifest,
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{config.root}/tables/{name}")
    for fitted in result.fitted:
        fill_values(fitted.model, config.features).write.mode("overwrite").parquet(f"{config.root}/tables/fill_values/model={fitted.spec.name}")
    # The history is read by its own next version, so each run writes a new folder.
    result.validation.write.mode("overwrite").parquet(f"{config.root}/tables/valid_metrics/run={config.run_version}")
