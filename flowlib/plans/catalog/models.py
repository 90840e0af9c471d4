"""Spark ML queries over embeddings and order lines."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlib.operators import ml, quality, threshold
from flowlib.plans import views
from flowlib.plans.experiment import ExperimentConfig, run_experiment
from flowlib.plans.registry import query
from flowlib.scratch import new_path, stored

DIMENSIONS = 64
EMBEDDED = [f"x{i}" for i in range(DIMENSIONS)]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SPECS = {kind: ml.ModelSpec(kind, kind) for kind in ml.DEFAULT_PARAMS}


def embedded(spark, sf):
    """Embeddings as flows: all their numbers with gaps, and a class."""
    cells = [F.when(F.expr(f"vec_id % 17 <> {i}"), F.col("embedding")[i].cast("double")).alias(f"x{i}") for i in range(DIMENSIONS)]
    return views.table(spark, sf, "embeddings").select(
        "vec_id", *cells, F.expr("cast(label % 2 = 1 as int)").alias("label_binary"), F.expr("concat('c', label)").alias("label")
    )


def _gappy_lines(spark, sf):
    rows = views.flows_li(spark, sf)
    return rows.withColumns({c: F.when(F.expr(f"l_partkey % {p} <> 0"), F.col(c)) for c, p in zip(LINE_FEATURES, (5, 7, 11, 13))})


def _gap_sql(agg):
    parts = [f"SELECT '{c}' AS feature, {agg.format(f'CASE WHEN l_partkey % {p} <> 0 THEN {c} END')} AS fill_value FROM flows_li" for c, p in zip(LINE_FEATURES, (5, 7, 11, 13))]
    return " UNION ALL ".join(parts)


@query("class_weights", sql="""
SELECT source_file, y AS label_binary, count(*) FILTER (label_binary = y) AS n, count(*) / (2.0::DOUBLE * count(*) FILTER (label_binary = y)) AS class_weight
FROM flows_li CROSS JOIN (VALUES (0), (1)) v(y) GROUP BY 1, 2""", floats="class_weight")
def class_weights(spark, sf):
    return ml.class_weights(views.flows_li(spark, sf), ["source_file"])


@query("with_class_weight", sql="""
SELECT label_binary, class_weight, count(*) AS rows FROM (SELECT label_binary, (SELECT count(*) FROM flows) / (2.0::DOUBLE * count(*) OVER (PARTITION BY label_binary)) AS class_weight FROM flows) GROUP BY 1, 2""", floats="class_weight")
def with_class_weight(spark, sf):
    return ml.with_class_weight(views.flows(spark, sf)).groupBy("label_binary", "class_weight").agg(F.count("*").alias("rows"))


@query("impute_values", sql=_gap_sql("median({})"), floats="fill_value")
def impute_values(spark, sf):
    return ml.impute_values(_gappy_lines(spark, sf), LINE_FEATURES)


@query("impute_values_mean", sql=_gap_sql("avg({})"), floats="fill_value")
def impute_values_mean(spark, sf):
    return ml.impute_values(_gappy_lines(spark, sf), LINE_FEATURES, "mean")


_FILLED = ", ".join(
    f"coalesce(CASE WHEN l_partkey % {p} <> 0 THEN {c} END, avg(CASE WHEN l_partkey % {p} <> 0 THEN {c} END) OVER ()) AS {c}" for c, p in zip(LINE_FEATURES, (5, 7, 11, 13))
)


@query("impute_assemble", sql=f"SELECT l_orderkey, l_linenumber, {_FILLED} FROM flows_li", floats=" ".join(LINE_FEATURES))
def impute_assemble(spark, sf):
    """Cells of the assembled vector, gaps filled by the mean."""
    from pyspark.ml import Pipeline

    rows = _gappy_lines(spark, sf)
    filled = Pipeline(stages=ml.impute_stages(LINE_FEATURES, "mean")).fit(rows).transform(rows)
    cells = vector_to_array("features")
    return filled.select("l_orderkey", "l_linenumber", *[cells[i].alias(c) for i, c in enumerate(LINE_FEATURES)])


def _fit(spark, sf, name, weighted=False):
    rows = embedded(spark, sf)
    fit_rows = ml.with_class_weight(rows) if weighted else rows
    fitted = ml.fit_model(fit_rows, EMBEDDED, SPECS[name], weight="class_weight" if weighted else None)
    return fitted, ml.score_batch(fitted.model, rows, keep=("vec_id",))


def _report(scored, name):
    """What holds of any sound fit: class totals of the confusion counts, and scores that tell the classes apart."""
    rows = stored(scored.select("label_binary", "prediction", "score"), "scored").withColumn("model", F.lit(name))
    both = quality.confusion_metrics(rows, ["model"]).unionByName(threshold.roc_auc(rows, ["model"]), allowMissingColumns=True)
    return both.groupBy("model").agg(*[F.max(c).alias(c) for c in ("tp", "fn", "fp", "tn", "roc_auc")]).select(
        "model", (F.col("tp") + F.col("fn")).cast("bigint").alias("positives"), (F.col("fp") + F.col("tn")).cast("bigint").alias("negatives"), (F.col("roc_auc") > 0.5).alias("above_chance")
    )


def _report_sql(name):
    return f"SELECT '{name}' AS model, count(*) FILTER (label % 2 = 1) AS positives, count(*) FILTER (label % 2 <> 1) AS negatives, true AS above_chance FROM embeddings"


def _trainer(name):
    def train(spark, sf):
        return _report(_fit(spark, sf, name)[1], name)

    return train


query("train_logistic", sql=_report_sql("logistic_regression"))(_trainer("logistic_regression"))
query("train_forest", sql=_report_sql("random_forest"))(_trainer("random_forest"))
query("train_gbt", sql=_report_sql("gradient_boosting"))(_trainer("gradient_boosting"))


@query("weighted_fit", sql=_report_sql("random_forest"))
def weighted_fit(spark, sf):
    return _report(_fit(spark, sf, "random_forest", weighted=True)[1], "random_forest")


def _penalty_free(spark, sf, weighted):
    """A logistic fit without penalty on one class against the rest, with its rows: score, label and weight."""
    rows = embedded(spark, sf).withColumn("label_binary", F.expr("cast(label = 'c1' as int)"))
    rows = ml.with_class_weight(rows) if weighted else rows.withColumn("class_weight", F.lit(1.0))
    spec = ml.ModelSpec("plain", "logistic_regression", {"max_iter": 400, "tol": 1e-10})
    fitted = ml.fit_model(rows, EMBEDDED, spec, weight="class_weight")
    out = fitted.model.transform(rows)
    return out.select("label_binary", "class_weight", "features", ml.score_column(out.columns).alias("score"))


@query("logistic_gradient", sql=" UNION ALL ".join(
    f"SELECT '{weights}' AS weights, 'x{i}' AS feature, count(*) AS rows, true AS vanishes FROM embeddings" for weights in ("none", "class") for i in range(DIMENSIONS)
))
def logistic_gradient(spark, sf):
    """At the fitted coefficients of a logistic model the gradient of its weighted log loss is zero in every feature."""
    parts = []
    for weights in ("none", "class"):
        rows = stored(_penalty_free(spark, sf, weights == "class").select("*", vector_to_array("features").alias("x")), "gradient")
        off = F.col("class_weight") * (F.col("score") - F.col("label_binary"))
        sums = rows.agg(F.count("*").alias("rows"), F.sum("class_weight").alias("w"), *[F.sum(off * F.col("x")[i]).alias(f"x{i}") for i in range(DIMENSIONS)])
        cells = [F.struct(F.lit(f"x{i}").alias("feature"), (F.abs(F.col(f"x{i}") / F.col("w")) < 1e-4).alias("vanishes")) for i in range(DIMENSIONS)]
        parts.append(sums.select(F.lit(weights).alias("weights"), "rows", F.inline(F.array(*cells))))
    return parts[0].union(parts[1])


@query("weighted_balance", sql="""
SELECT w.weights, count(*) AS rows, count(*) FILTER (label = 1) AS positives, true AS balanced FROM embeddings CROSS JOIN (VALUES ('none'), ('class')) w(weights) GROUP BY 1""")
def weighted_balance(spark, sf):
    """Class weights move the mean score: without them it is the share of the positive class, with them, weighted, one half."""
    parts = []
    for weights in ("none", "class"):
        rows = _penalty_free(spark, sf, weights == "class")
        mean = F.sum(F.col("class_weight") * F.col("score")) / F.sum("class_weight")
        share = F.lit(0.5) if weights == "class" else F.avg("label_binary")
        parts.append(rows.agg(F.count("*").alias("rows"), F.sum("label_binary").alias("positives"), (F.abs(mean - share) < 1e-4).alias("balanced")).select(F.lit(weights).alias("weights"), "*"))
    return parts[0].union(parts[1])


@query("tree_fit_loss", sql="""
SELECT model, count(*) AS rows, true AS ranks_its_rows, true AS better_than_the_share FROM embeddings CROSS JOIN (VALUES ('random_forest'), ('gradient_boosting')) m(model) GROUP BY 1""")
def tree_fit_loss(spark, sf):
    """Tree models know the rows they were fitted on: nearly all pairs in order, and a log loss under half that of the class share."""
    parts = []
    for name in ("random_forest", "gradient_boosting"):
        rows = stored(_fit(spark, sf, name)[1].select("label_binary", "score").withColumn("model", F.lit(name)), "tree-scores")
        y, p = F.col("label_binary"), F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("score")))
        loss = rows.groupBy("model").agg(F.count("*").alias("rows"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("loss"), F.avg(y).alias("share"))
        entropy = -(F.col("share") * F.log("share") + (1 - F.col("share")) * F.log(1 - F.col("share")))
        both = loss.select("model", "rows", (F.col("loss") < 0.5 * entropy).alias("better_than_the_share")).unionByName(threshold.roc_auc(rows, ["model"]), allowMissingColumns=True)
        parts.append(both.groupBy("model").agg(F.max("rows").alias("rows"), (F.max("roc_auc") > 0.99).alias("ranks_its_rows"), F.bool_or("better_than_the_share").alias("better_than_the_share")))
    return parts[0].union(parts[1])


@query("score_batch", sql="SELECT vec_id, CAST(label % 2 = 1 AS INTEGER) AS label_binary, 'c' || label AS label, true AS in_range, true AS agrees FROM embeddings")
def score_batch(spark, sf):
    """Every row with its labels, whether its score is a probability, and whether its prediction follows from the score."""
    scored = _fit(spark, sf, "logistic_regression")[1]
    return scored.select(
        "vec_id", "label_binary", "label", F.col("score").between(0, 1).alias("in_range"), ((F.col("score") >= 0.5).cast("int") == F.col("prediction")).alias("agrees")
    )


@query("extract_score", sql="SELECT vec_id, true AS in_range, true AS agrees FROM embeddings")
def extract_score(spark, sf):
    """The score is a probability, and the hard prediction is the class that it favours."""
    fitted, _ = _fit(spark, sf, "gradient_boosting")
    out = fitted.model.transform(embedded(spark, sf))
    score, hard = ml.score_column(out.columns), ml.score_column(["spark_prediction"])
    return out.select("vec_id", score.between(0, 1).alias("in_range"), ((score > 0.5) == (hard == 1)).alias("agrees"))


@query("save_load_model", sql="SELECT count(*) AS rows, count(*) AS same FROM embeddings")
def save_load_model(spark, sf):
    """Scores of a stored and reloaded model equal those of the fitted one."""
    rows, path = embedded(spark, sf), new_path(spark, "model")
    fitted = ml.fit_model(rows, EMBEDDED, SPECS["random_forest"], path, weight=None)
    first = ml.score_batch(fitted.model, rows, keep=("vec_id",)).select("vec_id", F.col("score").alias("a"))
    second = ml.score_batch(ml.load_model(path), rows, keep=("vec_id",)).select("vec_id", F.col("score").alias("b"))
    return first.join(second, "vec_id").agg(F.count("*").alias("rows"), F.count_if(F.col("a") == F.col("b")).alias("same"))


@query("fit_persist", sql=" UNION ALL ".join(
    f"SELECT 'x{i}' AS feature, avg(CAST(embedding[{i + 1}] AS DOUBLE)) FILTER (vec_id % 17 <> {i}) AS fill_value FROM embeddings" for i in range(DIMENSIONS)
), floats="fill_value")
def fit_persist(spark, sf):
    """Fill values of a stored and reloaded fit."""
    path = new_path(spark, "persisted")
    ml.fit_model(embedded(spark, sf), EMBEDDED, SPECS["logistic_regression"], path, weight=None, strategy="mean")
    return ml.fill_values(ml.load_model(path), EMBEDDED)


@query("score_stream", sql="SELECT count(*) AS rows, count(*) AS same FROM embeddings")
def score_stream(spark, sf):
    """Scores of a stream equal those of the batch."""
    from flowlib.streaming import runs, scoring

    rows, path, out = embedded(spark, sf), new_path(spark, "score-input"), new_path(spark, "score-output")
    rows.write.parquet(path)
    fitted = ml.fit_model(rows, EMBEDDED, SPECS["logistic_regression"], weight=None)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    scored = scoring.model_score(stream, fitted.model, 0.5, "logistic_regression", "embedded", "live").select("vec_id", "prediction_score")
    runs.drain(runs.table_writer(scored, out, new_path(spark, "score-checkpoint"), "scored-stream"))
    batch = ml.score_batch(fitted.model, rows, keep=("vec_id",))
    both = batch.join(spark.read.schema("vec_id bigint, prediction_score double").parquet(out), "vec_id")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("score") == F.col("prediction_score")).alias("same"))


@query("experiment", sql="""
SELECT model, split, count(*) AS n, count(*) FILTER (label % 2 = 1) AS positives FROM (
  SELECT label, CASE WHEN b IN (6, 7) THEN 'calibration' WHEN b = 8 THEN 'test_seen_temporal' ELSE 'test_unseen_family' END AS split
  FROM (SELECT label, ('0x'||substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT % 10 AS b FROM embeddings) WHERE b >= 6) AS evaluated
CROSS JOIN (VALUES ('logistic_regression'), ('random_forest')) AS m(model) GROUP BY 1, 2""")
def experiment(spark, sf):
    """Two models fitted, calibrated and tested: rows and attacks that each was judged on, over all evaluated splits."""
    rows = embedded(spark, sf).withColumn("_b", F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 8), 16, 10).cast("bigint") % 10)
    config = ExperimentConfig("embedded", EMBEDDED, [SPECS["logistic_regression"], SPECS["random_forest"]], new_path(spark, "experiment"))
    result = run_experiment(
        spark, config, rows.where("_b < 6"), rows.where("_b in (6, 7)"), {"test_seen_temporal": rows.where("_b = 8"), "test_unseen_family": rows.where("_b = 9")}
    )
    tables = result.validation.unionByName(result.test_summary, allowMissingColumns=True)
    attacks = (F.col("tp") + F.col("fn")).cast("bigint")
    return tables.select("model", "split", (attacks + F.col("fp") + F.col("tn")).cast("bigint").alias("n"), attacks.alias("positives"))
