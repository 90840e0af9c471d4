"""ROC AUC, thresholds under a false-positive budget, operating points and the best model.

Scores are collapsed to one row per distinct score first, so ties, however many, cost one row. They are
then range-partitioned and stored in chunks; ranks come from prefix sums over chunks and inside a chunk,
so no window ever holds all scores, however close together they lie. A threshold admits or rejects a
whole tie group, so it never breaks its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlib.functions.values import apply_threshold, next_above
from flowlib.operators.ordered import CHUNK, POSITION, in_chunks, join_same
from flowlib.operators.quality import rates_or_zero
from flowlib.scratch import small_side, stored

# Budgets reported for every model, and the one that picks its threshold.
FPR_BUDGETS = (0.01, 0.03, 0.05, 0.10)
PRIMARY_FPR_BUDGET = 0.03
DEFAULT_THRESHOLD = 0.5


def score_table(df: DataFrame, keys: list[str], label: str = "label_binary", score: str = "score") -> DataFrame:
    """One row per distinct score: ``pos``, ``neg`` at it, ``neg_below``, ``neg_from`` (at or above) and group totals."""
    positive = (F.col(label) == 1).cast("long")
    negative = (F.col(label) == 0).cast("long")
    rows = df.select(*keys, F.col(score).cast("double").alias("score"), positive.alias("_y"), negative.alias("_z"))
    distinct = rows.where("score is not null and not isnan(score)").groupBy(*keys, "score").agg(F.sum("_y").alias("pos"), F.sum("_z").alias("neg"))
    names = [f"`{k}`" for k in keys]
    by = ", ".join(names) or "1"
    # One key of group and chunk, null only inside, so that the join below and the window after it share one shuffle.
    at = F.struct(*keys, CHUNK).alias("_at")
    placed = in_chunks(distinct, keys, ["score"], "score_values").select("*", at)
    chunks = placed.groupBy(*keys, CHUNK).agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn")).select("*", at).selectExpr(
        "_at",
        f"sum(_bn) over (partition by {by} order by {CHUNK} rows unbounded preceding) - _bn as _before",
        f"sum(_bp) over (partition by {by}) as n_pos",
        f"sum(_bn) over (partition by {by}) as n_neg",
    )
    below = f"_before + sum(neg) over (partition by _at order by {POSITION} rows unbounded preceding) - neg"
    joined = placed.join(small_side(chunks, "score_chunks"), "_at")
    return joined.selectExpr(*names, "score", "pos", "neg", "n_pos", "n_neg", f"{below} as neg_below").withColumn("neg_from", F.col("n_neg") - F.col("neg_below"))


def _auc() -> Column:
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    pairs = F.max("n_pos").cast("double") * F.max("n_neg")
    return F.when(pairs > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), wins / pairs))).otherwise(F.lit(0.0))


def roc_auc(df: DataFrame, keys: list[str], label: str = "label_binary", score: str = "score") -> DataFrame:
    """Mann-Whitney AUC with half credit for ties; 0.0 when a class is missing."""
    return score_table(df, keys, label, score).groupBy(*keys).agg(_auc().alias("roc_auc"))


def _threshold(budget: float) -> Column:
    """Lowest positive score within the budget; without one, the top score or the next double above it."""
    admissible = F.col("neg_from") / F.col("n_neg") <= F.lit(float(budget))
    best = F.min(F.when(admissible & (F.col("pos") > 0), F.col("score")))
    top = F.max("score")
    top_admissible = F.max(F.when(admissible, F.col("score"))).isNotNull()
    one_class = (F.max("n_pos") == 0) | (F.max("n_neg") == 0)
    fallback = F.when(top_admissible, top).otherwise(next_above(top))
    return F.when(one_class, F.lit(DEFAULT_THRESHOLD)).otherwise(F.coalesce(best, fallback))


def budget_name(budget: float) -> str:
    return f"fpr_{int(round(budget * 100))}pct"


def thresholds_for_budgets(scores: DataFrame, keys: list[str], budgets: tuple[float, ...] = FPR_BUDGETS) -> DataFrame:
    """One row per group with a threshold column per budget and the AUC, from a ``score_table``."""
    # n_neg = 0 divides to null, which admits nothing; the one-class rule then applies.
    safe = scores.withColumn("n_neg", F.when(F.col("n_neg") > 0, F.col("n_neg")))
    safe = safe.withColumn("neg_from", F.coalesce("neg_from", F.lit(0)))
    columns = [_threshold(b).alias(budget_name(b)) for b in budgets]
    out = safe.groupBy(*keys).agg(F.max("n_pos").alias("n_pos"), F.coalesce(F.max("n_neg"), F.lit(0)).alias("n_neg"), _auc().alias("roc_auc"), *columns)
    none = (F.col("n_neg") == 0) | (F.col("n_pos") == 0)
    return out.withColumns(
        {budget_name(b): F.when(none, F.lit(DEFAULT_THRESHOLD)).otherwise(F.col(budget_name(b))) for b in budgets}
    )


def threshold_for_fpr_budget(
    df: DataFrame, keys: list[str], budget: float = PRIMARY_FPR_BUDGET, label: str = "label_binary", score: str = "score"
) -> DataFrame:
    """Per group, the threshold with the best recall whose false-positive rate stays within ``budget``."""
    found = thresholds_for_budgets(score_table(df, keys, label, score), keys, (budget,))
    return found.select(*keys, F.col(budget_name(budget)).alias("threshold"))


def operating_points(
    df: DataFrame,
    keys: list[str],
    budgets: tuple[float, ...] = FPR_BUDGETS,
    label: str = "label_binary",
    score: str = "score",
) -> DataFrame:
    """Threshold, confusion counts, rates and AUC at every budget and at 0.5, one row per group and point.

    The distinct scores are stored once; thresholds, and then all points together, are passes over them.
    """
    scores = stored(score_table(df, keys, label, score), "scores")
    found = small_side(thresholds_for_budgets(scores, keys, budgets)).withColumn("default_0.5", F.lit(DEFAULT_THRESHOLD))
    names = [*[budget_name(b) for b in budgets], "default_0.5"]
    joined = join_same(scores.select(*keys, "score", "pos", "neg"), found, keys, "inner")
    sums = [F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), F.max("roc_auc").alias("roc_auc")]
    for i, name in enumerate(names):
        hit = F.col("score") >= F.col(f"`{name}`")
        sums.append(F.struct(
            F.lit(name).alias("point"),
            F.max(f"`{name}`").alias("threshold"),
            F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        ).alias(f"_p{i}"))
    grouped = joined.groupBy(*keys).agg(*sums)
    points = grouped.select(
        *keys, "n_pos", "n_neg", F.round("roc_auc", 6).alias("roc_auc"),
        F.explode(F.array(*[F.col(f"_p{i}") for i in range(len(names))])).alias("_p"),
    ).select(*keys, "roc_auc", "_p.*", (F.col("n_pos") - F.col("_p.tp")).alias("fn"), (F.col("n_neg") - F.col("_p.fp")).alias("tn"))
    return rates_or_zero(points)


def predict_at(scored: DataFrame, thresholds: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Add ``threshold`` (one row per group in ``thresholds``) and ``prediction``."""
    joined = join_same(scored, thresholds.select(*keys, "threshold"), keys, "left")
    return joined.withColumn("prediction", apply_threshold(F.col(score), F.col("threshold")))


def select_best_model(metrics: DataFrame) -> DataFrame:
    """The row with the highest recall, then lowest fpr, then highest precision, then first model name."""
    return metrics.orderBy(F.desc("recall"), F.asc("fpr"), F.desc("precision"), F.asc("model")).limit(1)
