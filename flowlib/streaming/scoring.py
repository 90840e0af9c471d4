"""Scoring columns and the whole record-to-prediction plan; the same on batch and streaming frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlib.functions.timing import with_event_lateness, with_event_timing, with_processing_latency, with_source_latency
from flowlib.functions.values import apply_threshold
from flowlib.operators.ml import score_column
from flowlib.streaming.source import filter_run_tag, parse_json_flow, split_control_data


@dataclass(frozen=True)
class ScoringConfig:
    """``score`` is an expression over the features that stands in for a model; without both, scores are null."""

    features: tuple[str, ...]
    model_name: str
    feature_set: str
    run_tag: str
    input_run_tag: str = ""
    model_path: str | None = None
    score: str | None = None
    threshold: float = 0.5
    stream_started_epoch_ms: int = 0


def _tags(model_name: str, feature_set: str, run_tag: str, emit: Column | None) -> dict[str, Column]:
    return {
        "emit_time": F.current_timestamp() if emit is None else emit,
        "model_name": F.lit(model_name),
        "feature_set": F.lit(feature_set),
        "run_tag": F.lit(run_tag),
    }


def passthrough_score(df: DataFrame, model_name: str, feature_set: str, run_tag: str, emit: Column | None = None) -> DataFrame:
    """No score, label or threshold; emit time and tags are filled."""
    empty = {
        "prediction_score": F.lit(None).cast("double"),
        "prediction_label": F.lit(None).cast("int"),
        "threshold_used": F.lit(None).cast("double"),
    }
    return df.withColumns({**empty, **_tags(model_name, feature_set, run_tag, emit)})


def expression_score(
    df: DataFrame, score: Column, threshold: float, model_name: str, feature_set: str, run_tag: str, emit: Column | None = None
) -> DataFrame:
    """Score, label at the threshold, emit time and tags."""
    columns = {
        "prediction_score": score,
        "prediction_label": apply_threshold(score, threshold),
        "threshold_used": F.lit(float(threshold)),
    }
    return df.withColumns({**columns, **_tags(model_name, feature_set, run_tag, emit)})


def model_score(
    df: DataFrame, model: PipelineModel, threshold: float, model_name: str, feature_set: str, run_tag: str, emit: Column | None = None
) -> DataFrame:
    """Score with a fitted pipeline; intermediate model columns are dropped."""
    scored = model.transform(df)
    out = expression_score(scored, score_column(scored.columns), threshold, model_name, feature_set, run_tag, emit)
    added = ["prediction_score", "prediction_label", "threshold_used", "emit_time", "model_name", "feature_set", "run_tag"]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *added)


def score_records(records: DataFrame, config: ScoringConfig, emit: Column | None = None) -> DataFrame:
    """Data records of the chosen run with timing, score and latencies."""
    data, _ = split_control_data(filter_run_tag(records, config.input_run_tag))
    timed = with_event_lateness(with_event_timing(data))
    tags = (config.model_name, config.feature_set, config.run_tag, emit)
    if config.model_path:
        scored = model_score(timed, PipelineModel.load(config.model_path), config.threshold, *tags)
    elif config.score:
        scored = expression_score(timed, F.expr(config.score), config.threshold, *tags)
    else:
        scored = passthrough_score(timed, *tags)
    return with_processing_latency(with_source_latency(scored), config.stream_started_epoch_ms)


def score_pipeline(envelope: DataFrame, config: ScoringConfig, emit: Column | None = None) -> DataFrame:
    """JSON envelope to predictions: parse, filter, split control records, time, score, latencies."""
    return score_records(parse_json_flow(envelope, list(config.features)), config, emit)
