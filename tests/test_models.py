from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowlib.operators import ml, threshold
from flowlib.plans.experiment import ExperimentConfig, run_experiment, write_results
from flowlib.streaming import runs, scoring
from tests.conftest import rows

FEATURES = ["Flow Byts/s", "x"]
SPECS = [ml.ModelSpec("logistic_regression", "logistic_regression", {"max_iter": 8}), ml.ModelSpec("random_forest", "random_forest", {"num_trees": 5, "max_depth": 4}),
         ml.ModelSpec("gradient_boosting", "gradient_boosting", {"max_iter": 3, "max_depth": 3})]


@pytest.fixture(scope="module")
def flows(spark):
    base = spark.range(1200).select("id", F.randn(1).alias("a"), F.randn(2).alias("b"))
    return base.select(
        "id", F.expr("if(id % 20 = 0, null, a)").alias("Flow Byts/s"), F.col("b").alias("x"), F.expr("cast(a + b / 2 > 0.6 as int)").alias("label_binary"), F.expr("if(a + b / 2 > 0.6, 'Bot', 'Benign')").alias("label")
    ).cache()


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "label_binary int")
    assert rows(ml.class_weights(df).select("label_binary", "class_weight"), "label_binary") == [(0, 4 / 6), (1, 2.0)]
    assert rows(ml.with_class_weight(df.where("label_binary = 0")).select("class_weight").distinct()) == [(1.0,)]
    assert rows(ml.with_class_weight(df).where("label_binary = 1").select("class_weight")) == [(2.0,)]


def test_exact_impute_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None), (None, None)], "`Flow Byts/s` double, x double")
    assert dict(rows(ml.impute_values(df, FEATURES))) == {"Flow Byts/s": 2.5, "x": 0.0}
    assert dict(rows(ml.impute_values(df, FEATURES, "mean"))) == {"Flow Byts/s": 4.0, "x": 0.0}
    with pytest.raises(ValueError):
        ml.impute_values(df, FEATURES, "mode")


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: s.name)
def test_models_learn_and_repeat(flows, spec):
    first = ml.fit_model(flows, FEATURES, spec, weight=None)
    scored = ml.score_batch(first.model, flows, keep=("id",))
    assert scored.columns == ["id", "label_binary", "prediction", "score", "label"]
    assert threshold.roc_auc(scored.withColumn("m", F.lit(1)), ["m"]).first().roc_auc > 0.9
    again = ml.score_batch(ml.fit_model(flows, FEATURES, spec, weight=None).model, flows, keep=("id",))
    assert scored.select("id", "score").exceptAll(again.select("id", "score")).count() == 0


def test_unknown_kind():
    with pytest.raises(ValueError):
        ml.estimator(ml.ModelSpec("x", "svm"))


def test_parameters_are_not_clamped():
    est = ml.estimator(ml.ModelSpec("rf", "random_forest", {"num_trees": 200, "max_depth": 20}))
    assert (est.getNumTrees(), est.getMaxDepth(), est.getWeightCol(), est.getSeed()) == (200, 20, "class_weight", 42)


def test_score_column_choice():
    for columns, expected in ((["probability", "rawPrediction"], "probability"), (["rawPrediction"], "rawPrediction"), (["raw_prediction", "rawPrediction"], "raw_prediction"), (["x"], "spark_prediction")):
        assert expected in str(ml.score_column(columns)._jc)


def test_save_load_and_stream_parity(spark, flows, tmp_path):
    path = str(tmp_path / "model")
    fitted = ml.fit_model(ml.with_class_weight(flows), FEATURES, SPECS[1], path)
    fitted = ml.fit_model(ml.with_class_weight(flows), FEATURES, SPECS[1], path)
    batch = ml.score_batch(fitted.model, flows, keep=("id",)).select("id", F.col("score").alias("prediction_score"))
    flows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(flows.schema).parquet(str(tmp_path / "in"))
    scored = scoring.model_score(stream, ml.load_model(path), 0.5, "m", "full", "live")
    assert set(flows.columns) < set(scored.columns) and "features" not in scored.columns
    runs.drain(runs.table_writer(scored.select("id", "prediction_score"), str(tmp_path / "out"), str(tmp_path / "cp"), "parity"))
    assert batch.exceptAll(spark.read.parquet(str(tmp_path / "out"))).count() == 0
    assert {r.feature for r in ml.fill_values(fitted.model, FEATURES).collect()} == set(FEATURES)


def test_experiment(spark, flows, tmp_path):
    config = ExperimentConfig("two", FEATURES, SPECS[:2], str(tmp_path / "exp"), run_version=1)
    split = flows.withColumn("s", F.col("id") % 4)
    got = run_experiment(spark, config, split.where("s < 2"), split.where("s = 2"), {"test_seen_temporal": split.where("s = 3")})
    write_results(got, config)
    validation = {r.model: r for r in got.validation.collect()}
    assert set(validation) == {"logistic_regression", "random_forest"}
    for r in validation.values():
        assert r.fpr <= 0.03 and r.roc_auc > 0.9 and r.default_recall is not None
    assert got.test_summary.count() == 2 and got.points.count() == 10
    best = max(validation.values(), key=lambda r: (r.recall, -r.fpr, r.precision))
    manifest = spark.read.parquet(f"{config.root}/tables/feature_manifest").first()
    assert manifest.model == best.model and manifest.feature_columns == FEATURES and manifest.model_path.endswith(best.model)
    history = spark.read.parquet(f"{config.root}/tables/valid_metrics/run=1")
    rerun = run_experiment(spark, ExperimentConfig("two", FEATURES, SPECS[:1], str(tmp_path / "exp"), run_version=2), split.where("s < 2"), split.where("s = 2"), {}, history)
    assert {(r.model, r.version) for r in rerun.validation.collect()} == {("logistic_regression", 2), ("random_forest", 1)}
    assert {r.model for r in got.per_attack.collect()} == {"logistic_regression", "random_forest"}
