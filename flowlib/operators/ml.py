"""Spark ML: impute, assemble, weight, fit, persist and score.

Sizes of models are parameters with plain defaults; nothing is clamped behind the caller's back.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlib.functions.values import apply_threshold
from flowlib.operators.percentiles import exact_percentiles

WEIGHT = "class_weight"
HARD_PREDICTION = "spark_prediction"

# Defaults of the three model kinds.
DEFAULT_PARAMS: dict[str, dict[str, Any]] = {
    "logistic_regression": {"max_iter": 50, "reg_param": 0.0, "elastic_net_param": 0.0, "tol": 1e-6},
    "random_forest": {"num_trees": 64, "max_depth": 12, "min_instances_per_node": 1, "seed": 42},
    "gradient_boosting": {"max_iter": 40, "max_depth": 6, "step_size": 0.1, "min_instances_per_node": 1, "seed": 42},
}


@dataclass(frozen=True)
class ModelSpec:
    name: str
    kind: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class FittedModel:
    spec: ModelSpec
    model: PipelineModel
    path: str | None
    train_time_s: float


def class_weights(df: DataFrame, keys: list[str] | None = None, label: str = "label_binary") -> DataFrame:
    """Weight ``total / (2 * class rows)`` per class, 1.0 for all when a class is missing; at most two rows per group."""
    keys = list(keys or [])
    y = F.col(label).cast("int")
    counts = df.groupBy(*keys).agg(F.count_if(y == 0).alias("_n0"), F.count_if(y == 1).alias("_n1"))
    total = F.col("_n0") + F.col("_n1")
    one_class = (F.col("_n0") == 0) | (F.col("_n1") == 0)
    rows = counts.select(
        *keys, one_class.alias("_one"), total.alias("_total"),
        F.explode(F.array(F.struct(F.lit(0).alias(label), F.col("_n0").alias("n")), F.struct(F.lit(1).alias(label), F.col("_n1").alias("n")))).alias("_c"),
    ).select(*keys, "_one", "_total", "_c.*")
    weight = F.when(F.col("_one"), F.lit(1.0)).otherwise(F.col("_total") / (2.0 * F.col("n")))
    return rows.select(*keys, label, "n", weight.alias(WEIGHT))


def with_class_weight(df: DataFrame, label: str = "label_binary") -> DataFrame:
    """Add the balanced class weight; the weight table has two rows, so it is broadcast."""
    weights = class_weights(df, label=label).select(F.col(label).alias("_y"), WEIGHT)
    joined = df.join(F.broadcast(weights), F.col(label).cast("int") == F.col("_y"), "left").drop("_y")
    return joined.withColumn(WEIGHT, F.coalesce(WEIGHT, F.lit(1.0)))


def impute_values(df: DataFrame, features: list[str], strategy: str = "median") -> DataFrame:
    """Exact fill value of each feature as rows ``(feature, fill_value)``; 0.0 for a feature without values."""
    if strategy == "mean":
        one = df.agg(*[F.avg(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))).alias(f"f{i}") for i, c in enumerate(features)])
    elif strategy == "median":
        renamed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(features)])
        one = exact_percentiles(renamed, [], {f"f{i}": (f"c{i}", 0.5) for i in range(len(features))})
    else:
        raise ValueError(f"impute strategy must be median or mean, got {strategy!r}")
    cells = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"f{i}"), F.lit(0.0)).alias("fill_value")) for i, c in enumerate(features)]
    return one.select(F.inline(F.array(*cells)))


def impute_stages(features: list[str], strategy: str = "median", relative_error: float = 0.001) -> list:
    """Imputer to ``<feature>__imputed`` and assembler to ``features`` (invalid rows kept)."""
    if strategy not in ("median", "mean"):
        raise ValueError(f"impute strategy must be median or mean, got {strategy!r}")
    imputed = [f"{c}__imputed" for c in features]
    imputer = Imputer(inputCols=features, outputCols=imputed, strategy=strategy, relativeError=relative_error)
    return [imputer, VectorAssembler(inputCols=imputed, outputCol="features", handleInvalid="keep")]


def estimator(spec: ModelSpec, label: str = "label_binary", weight: str | None = WEIGHT):
    if spec.kind not in DEFAULT_PARAMS:
        raise ValueError(f"unknown model kind {spec.kind!r}")
    p = {**DEFAULT_PARAMS[spec.kind], **spec.params}
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": HARD_PREDICTION}
    named = {**common, "probabilityCol": "probability", "rawPredictionCol": "raw_prediction"}
    if spec.kind == "logistic_regression":
        est = LogisticRegression(
            maxIter=p["max_iter"], regParam=p["reg_param"], elasticNetParam=p["elastic_net_param"], standardization=True, tol=p["tol"], **named
        )
    elif spec.kind == "random_forest":
        est = RandomForestClassifier(
            numTrees=p["num_trees"], maxDepth=p["max_depth"], minInstancesPerNode=p["min_instances_per_node"], seed=p["seed"], **named
        )
    else:
        est = GBTClassifier(
            maxIter=p["max_iter"], maxDepth=p["max_depth"], stepSize=p["step_size"],
            minInstancesPerNode=p["min_instances_per_node"], seed=p["seed"], **common
        )
    return est.setWeightCol(weight) if weight else est


def training_pipeline(
    features: list[str], spec: ModelSpec, strategy: str = "median", label: str = "label_binary", weight: str | None = WEIGHT
) -> Pipeline:
    return Pipeline(stages=[*impute_stages(features, strategy), estimator(spec, label, weight)])


def fit_model(df: DataFrame, features: list[str], spec: ModelSpec, path: str | None = None, **how) -> FittedModel:
    """Fit, time and, with a path, save over any earlier model there."""
    started = time.perf_counter()
    model = training_pipeline(features, spec, **how).fit(df)
    elapsed = time.perf_counter() - started
    if path:
        model.write().overwrite().save(path)
    return FittedModel(spec, model, path, elapsed)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fill_values(model: PipelineModel, features: list[str]) -> DataFrame:
    """Fill values the fitted imputer holds (one row in the model) as ``(feature, fill_value)`` rows."""
    surrogate = model.stages[0].surrogateDF
    cells = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias("fill_value")) for c in features]
    return surrogate.select(F.inline(F.array(*cells)))


def score_column(columns: list[str]) -> Column:
    """Attack score: probability of class 1, else its raw prediction, else the hard prediction."""
    for name in ("probability", "raw_prediction", "rawPrediction"):
        if name in columns:
            return vector_to_array(F.col(name)).getItem(1)
    return F.col(HARD_PREDICTION).cast("double")


def score_batch(
    model: PipelineModel, df: DataFrame, threshold: float = 0.5, label: str = "label_binary", attack_label: str = "label",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Label, prediction, score and, where present, attack label of every row."""
    scored = model.transform(df)
    scored = scored.withColumn("score", score_column(scored.columns).cast("double"))
    extra = [attack_label] if attack_label in scored.columns else []
    prediction = apply_threshold(F.col("score"), threshold).alias("prediction")
    return scored.select(*keep, label, prediction, "score", *extra)
