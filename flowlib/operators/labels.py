"""Late labels joined back to predictions by (partition, offset)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlib.functions.values import collector_phase
from flowlib.operators.quality import row_barrier
from flowlib.sources.tables import artifact_frame

OFFSET_KEYS = ["kafka_partition", "kafka_offset"]
SPREAD = "_spread"


def semi_join_required_keys(inputs: DataFrame, preds: DataFrame, run_tag: str | None = None) -> DataFrame:
    """Input records some prediction needs; control records, and records of other runs, are left out."""
    rows = inputs
    if run_tag is not None and "replay_run_tag" in inputs.columns:
        rows = rows.where(F.coalesce("replay_run_tag", F.lit("")) == run_tag)
    if "is_control_record" in inputs.columns:
        rows = rows.where(F.coalesce("is_control_record", F.lit(0)) == 0)
    # Repeats are combined before the shuffle that the join needs anyway.
    needed = preds.select(*OFFSET_KEYS).dropna().distinct()
    return rows.join(needed, OFFSET_KEYS, "left_semi")


def join_labels_by_offset(preds: DataFrame, inputs: DataFrame, run_tag: str | None = None, per_run: bool = False) -> DataFrame:
    """Every prediction (repeats included) with the label of its input record, null where there is none.

    (partition, offset) names one input record, so the join key is never hot. Predictions without an
    offset match nothing; a hash of the row spreads them, since their null keys would all go to one task.
    ``per_run`` takes labels only from input records of the prediction's own run (``replay_run_tag`` = ``run_tag``).
    """
    keys, labels = list(OFFSET_KEYS), inputs
    if run_tag is not None and "replay_run_tag" in inputs.columns:
        labels = labels.where(F.coalesce("replay_run_tag", F.lit("")) == run_tag)
    if "is_control_record" in inputs.columns:
        labels = labels.where(F.coalesce("is_control_record", F.lit(0)) == 0)
    if per_run:
        keys, labels = [*keys, "run_tag"], labels.drop("run_tag").withColumnRenamed("replay_run_tag", "run_tag")
    labels = labels.select(*keys, F.lit(0).cast("bigint").alias(SPREAD), "label_binary", "label")
    bare = preds.drop("label_binary", "label")
    placed = F.col("kafka_partition").isNotNull() & F.col("kafka_offset").isNotNull()
    cells = [F.col(f"`{c}`") for c, kind in bare.dtypes if "map<" not in kind]
    spread = bare.withColumn(SPREAD, F.when(placed, F.lit(0).cast("bigint")).otherwise(F.xxhash64(*cells)))
    return spread.join(labels, [*keys, SPREAD], "left").select(*[F.col(f"`{c}`") for c in bare.columns], "label_binary", "label")


def collect_artifact(preds: DataFrame, inputs: DataFrame, run_tag: str, phases: list[str]) -> DataFrame:
    """Stored form of a run: its predictions of the expected phases, phase normalized, labels joined, fixed layout."""
    mine = preds.where(F.col("run_tag") == run_tag).withColumn("benchmark_phase", collector_phase(F.col("benchmark_phase")))
    mine = mine.where(F.col("benchmark_phase").isin(*phases))
    return artifact_frame(join_labels_by_offset(mine, inputs, run_tag))


def collect_artifacts(preds: DataFrame, inputs: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored form, barrier) of all runs in one pass over the topic.

    ``expected(run_tag, phase, expected)`` names the phases a run must hold and their rows; predictions of other runs and
    phases are left out. The barrier has one row per run and phase: expected, actual and missing rows, labelled rows and
    ``status`` (``ok`` or ``incomplete``).
    """
    wanted = expected.where("expected > 0").select("run_tag", collector_phase(F.col("phase")).alias("benchmark_phase")).distinct()
    mine = preds.withColumn("benchmark_phase", collector_phase(F.col("benchmark_phase"))).join(wanted, ["run_tag", "benchmark_phase"], "left_semi")
    artifact = artifact_frame(join_labels_by_offset(mine.select(*preds.columns), inputs, per_run=True))
    labelled = label_coverage(artifact, ["run_tag", "benchmark_phase"]).select(
        "run_tag", F.col("benchmark_phase").alias("phase"), F.col("artifact_collect_labeled_rows").alias("_labelled")
    )
    barrier = row_barrier(artifact, expected).join(labelled, ["run_tag", "phase"], "left")
    return artifact, barrier.withColumn("artifact_collect_labeled_rows", F.coalesce("_labelled", F.lit(0))).drop("_labelled")


def label_coverage(joined: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows and labelled rows."""
    return joined.groupBy(*(keys or [])).agg(
        F.count("*").alias("artifact_collect_rows"), F.count("label_binary").alias("artifact_collect_labeled_rows")
    )
