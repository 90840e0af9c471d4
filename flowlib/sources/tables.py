"""Parquet scans and sinks: modeling splits, scored splits, prediction artifacts, file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlib.functions.values import collector_phase

# Layout of a prediction response and of the stored artifact.
PREDICTION_COLUMNS = {
    "flow_id": "string",
    "model_name": "string",
    "feature_set": "string",
    "run_tag": "string",
    "benchmark_phase": "string",
    "prediction_label": "int",
    "prediction_score": "double",
    "threshold_used": "double",
    "kafka_partition": "int",
    "kafka_offset": "bigint",
    "event_time_ts": "timestamp",
    "ingest_time": "timestamp",
    "emit_time": "timestamp",
    "source_to_ingest_ms": "double",
    "processing_ms": "double",
    "end_to_end_ms": "double",
    "event_lateness_ms": "double",
    "is_late_event": "int",
}
ARTIFACT_COLUMNS = {**PREDICTION_COLUMNS, "label_binary": "int", "label": "string"}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with naive timestamps taken as instants in the session time zone (UTC)."""
    df = spark.read.parquet(path)
    naive = [name for name, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(f"`{c}`").cast("timestamp") for c in naive}) if naive else df


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def select_features(df: DataFrame, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the named feature set (and ``keep``), in registry order."""
    require_columns(df, [*features, *keep])
    return df.select(*[F.col(f"`{c}`") for c in (*keep, *features)])


def modeling_frame(
    df: DataFrame, features: list[str], label: str = "label_binary", attack_label: str | None = None
) -> DataFrame:
    """Features as double, label as int and, on request, the attack label as text; a missing column is an error."""
    require_columns(df, [*features, label, *([attack_label] if attack_label else [])])
    columns = [F.col(f"`{c}`").cast("double").alias(c) for c in features]
    columns.append(F.col(f"`{label}`").cast("int").alias(label))
    if attack_label:
        columns.append(F.col(f"`{attack_label}`").cast("string").alias(attack_label))
    return df.select(*columns)


def scan_modeling_split(
    spark: SparkSession, path: str, split: str, features: list[str], label: str = "label_binary", attack_label: str | None = None
) -> DataFrame:
    """One split of a table partitioned by ``split``: other splits' files and unused columns are not read."""
    return modeling_frame(spark.read.parquet(path).where(F.col("split") == split), features, label, attack_label)


def artifact_frame(df: DataFrame, layout: dict[str, str] = ARTIFACT_COLUMNS) -> DataFrame:
    """Exactly the columns of ``layout`` in its order and types; absent ones are null."""
    return df.select(
        *[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in layout.items()]
    )


def write_prediction_artifact(df: DataFrame, path: str) -> None:
    artifact_frame(df).write.mode("overwrite").parquet(path)


def write_run_artifacts(df: DataFrame, path: str) -> None:
    """Artifacts of many runs as one table partitioned by run and normalized phase, so that both filters skip files."""
    stored = artifact_frame(df).withColumn("benchmark_phase", collector_phase(F.col("benchmark_phase")))
    stored.write.mode("overwrite").partitionBy("run_tag", "benchmark_phase").parquet(path)


def read_run_artifacts(spark: SparkSession, path: str, runs: list[str] | None = None, phase: str | None = None) -> DataFrame:
    """Pooled artifacts of the named runs and phase (all by default); other runs' and phases' files are not read."""
    df = spark.read.parquet(path)
    if runs is not None:
        df = df.where(F.col("run_tag").isin(list(runs)))
    return df.where(F.col("benchmark_phase") == phase) if phase else df


def save_scored_split(scored: DataFrame, path: str, model: str, split: str) -> None:
    """Replace one (model, split) part of the scored table and leave the others."""
    scored.drop("model", "split").write.mode("overwrite").parquet(f"{path}/model={model}/split={split}")


def input_manifest(spark: SparkSession, sources: dict[str, str], glob: str = "*") -> DataFrame:
    """Role, path, rows, modified time and status of every file behind ``{role: path}``."""
    frames = []
    for role, path in sources.items():
        files = spark.read.option("pathGlobFilter", glob).parquet(path)
        per_file = files.select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified")
        )
        frames.append(
            per_file.groupBy("path").agg(F.count("*").alias("rows"), F.max("modified").alias("modified")).select(
                F.lit(role).alias("role"), "path", "rows", "modified", F.lit("ok").alias("status")
            )
        )
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def latest_file(manifest: DataFrame) -> DataFrame:
    """Newest file per role; of equally new files the last by name."""
    return manifest.groupBy("role").agg(F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified"))
