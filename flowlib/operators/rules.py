"""Verdicts over run summary rows: service level, overload, drain, source stability, recovery, threshold lookup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlib.functions.values import numeric_or_null, to_number, trigger_interval_ms


@dataclass(frozen=True)
class SloLimits:
    min_throughput_ratio: float = 0.90
    min_rows_ratio: float = 0.95
    max_p50_e2e_ms: float = 500.0
    max_p95_e2e_ms: float = 1500.0


# Limit presets and rule limits.
STRICT_SLO = SloLimits()
PRACTICAL_SLO = SloLimits(max_p50_e2e_ms=2000.0, max_p95_e2e_ms=2000.0)
SMOKE_SLO = SloLimits(min_throughput_ratio=0.50, min_rows_ratio=1.0, max_p50_e2e_ms=2000.0, max_p95_e2e_ms=3000.0)
OVERLOAD_MAX_P95_MS = 2000.0
OVERLOAD_MIN_RATIO = 0.90
STABILITY_MAX_GAP_MS = 1000.0
STABILITY_MIN_RATIO = 0.95
RECOVERY_MIN_ROWS_RATIO = 0.95


def _reasons(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order, joined by ``;``."""
    return F.concat_ws(";", *[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in pairs])


def _whole(value: Column) -> Column:
    return F.coalesce(value.cast("long"), F.lit(0))


def evaluate_slo(
    summary: DataFrame,
    limits: SloLimits = STRICT_SLO,
    target_rps: str = "target_rps",
    expected_rows: str = "rows_expected",
    trigger_interval: str = "trigger_interval",
) -> DataFrame:
    """Add the service-level verdict of each run and the reasons in fixed order."""
    number = {c: numeric_or_null(summary, c) for c in (
        "artifact_rows_total", "rows_total", "drain_rps", "artifact_e2e_p50_ms", "artifact_e2e_p95_ms",
        "artifact_e2e_p99_ms", target_rps, expected_rows, "kafka_lag_peak_records")}
    artifact_rows = _whole(number["artifact_rows_total"])
    rows = F.when(_whole(number["rows_total"]) != 0, _whole(number["rows_total"])).otherwise(artifact_rows)
    target, expected = number[target_rps], _whole(number[expected_rows])
    ratio = F.when(target > 0, number["drain_rps"] / target)
    p50, p95 = number["artifact_e2e_p50_ms"], number["artifact_e2e_p95_ms"]
    no_latency = p50.isNull() | p95.isNull()
    text = {c: F.col(c) if c in summary.columns else F.lit("") for c in ("latency_status", "replay_status", trigger_interval)}
    has_latency = (F.coalesce(text["latency_status"], F.lit("")) == "ok") & (artifact_rows > 0)
    reason = _reasons(
        (~has_latency, "artifact_latency_missing"),
        ((expected > 0) & (rows < expected * limits.min_rows_ratio), "rows_below_expected"),
        (ratio.isNull() | (ratio < limits.min_throughput_ratio), "throughput_below_target"),
        (no_latency, "latency_missing"),
        (~no_latency & (p50 > limits.max_p50_e2e_ms), "p50_e2e_exceeded"),
        (~no_latency & (p95 > limits.max_p95_e2e_ms), "p95_e2e_exceeded"),
        (text["replay_status"] == "unstable", "load_generator_unstable"),
    )
    out = summary.withColumns(
        {
            "rows_total": rows,
            "actual_rps": number["drain_rps"],
            "drain_rps": number["drain_rps"],
            "throughput_ratio": ratio,
            "p50_e2e_ms": p50,
            "p95_e2e_ms": p95,
            "p99_e2e_ms": number["artifact_e2e_p99_ms"],
            "trigger_interval_ms": trigger_interval_ms(text[trigger_interval]),
            "kafka_lag_peak_records": number["kafka_lag_peak_records"],
            "failure_reason": reason,
        }
    )
    return out.withColumn("slo_status", F.when(F.col("failure_reason") == "", F.lit("pass")).otherwise(F.lit("fail")))


def with_overload_ratios(summary: DataFrame, target_rps: str = "target_rps") -> DataFrame:
    """Drain rate over target, target over drain rate, peak lag over target; null where undefined."""
    target = numeric_or_null(summary, target_rps)
    drain = numeric_or_null(summary, "drain_rps")
    peak = numeric_or_null(summary, "kafka_lag_peak_records")
    return summary.withColumns(
        {
            "drain_throughput_ratio": F.when(target != 0, drain / target),
            "target_to_drain_ratio": F.when((drain != 0) & (target != 0), target / drain),
            "kafka_lag_peak_ratio": F.when(target != 0, peak / target),
        }
    )


def classify_overload(
    ratio: Column,
    p95_ms: Column,
    peak_ratio: Column | None = None,
    growth: Column | None = None,
    max_p95_ms: float = OVERLOAD_MAX_P95_MS,
    min_ratio: float = OVERLOAD_MIN_RATIO,
) -> Column:
    """``artifact_missing``, ``overloaded``, ``backpressure`` or ``stable``."""
    none = F.lit(None).cast("double")
    peak_ratio = none if peak_ratio is None else peak_ratio
    growth = none if growth is None else growth
    return (
        F.when(ratio.isNull() | p95_ms.isNull(), F.lit("artifact_missing"))
        .when((ratio < min_ratio) | (p95_ms > max_p95_ms), F.lit("overloaded"))
        .when((peak_ratio >= 1.0) | (growth > 0), F.lit("backpressure"))
        .otherwise(F.lit("stable"))
    )


def drain_barrier(summary: DataFrame) -> DataFrame:
    """Add ``drain_status`` (``ok``/``failed``) and ``drain_reason``: a run has drained only with no lag left."""
    word = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("kafka_lag_status", "kafka_lag_sampler_status")}
    end, last = (numeric_or_null(summary, c).cast("long") for c in ("kafka_lag_records_end", "kafka_lag_end_after_drain_records"))
    status, sampler = word["kafka_lag_status"], word["kafka_lag_sampler_status"]
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("missing"))
    reason = (
        F.when(status != "ok", F.concat(F.lit("kafka_lag_status="), F.when(status == "", F.lit("missing")).otherwise(status)))
        .when(end.isNull() | (end != 0), F.concat(F.lit("kafka_lag_records_end="), shown(end)))
        .when((sampler != "") & (sampler != "ok"), F.concat(F.lit("kafka_lag_sampler_status="), sampler))
        .when((sampler == "ok") & (last.isNull() | (last != 0)), F.concat(F.lit("kafka_lag_end_after_drain_records="), shown(last)))
        .otherwise(F.lit(""))
    )
    out = summary.withColumn("drain_reason", reason)
    return out.withColumn("drain_status", F.when(F.col("drain_reason") == "", F.lit("ok")).otherwise(F.lit("failed")))


def source_stability(
    target_rps: Column, actual_rps: Column, gap_max_ms: Column, tick_lag_max_ms: Column, stalls: Column
) -> Column:
    """Reasons why a replay was unstable, empty when it was stable."""
    return _reasons(
        (target_rps.isNotNull() & (actual_rps.isNull() | (actual_rps < target_rps * STABILITY_MIN_RATIO)), "replay_actual_rps_below_target"),
        (gap_max_ms > STABILITY_MAX_GAP_MS, "replay_emit_gap_spike"),
        (tick_lag_max_ms > STABILITY_MAX_GAP_MS, "replay_tick_lag_spike"),
        (stalls > 0, "replay_producer_buffer_stall"),
    )


def recovery_status(
    fault_kind: Column,
    initial_rows: Column,
    initial_expected: Column,
    post_rows: Column,
    post_expected: Column,
    checkpoint_present: Column,
    checkpoint_reset: Column,
    min_ratio: float = RECOVERY_MIN_ROWS_RATIO,
) -> Column:
    """Verdict of a cold start (``fault_kind`` = ``none``) or of a crash and restart."""
    zero = F.lit(0)
    short_before = F.coalesce(initial_rows, zero) < initial_expected * min_ratio
    short_after = F.coalesce(post_rows, zero) < post_expected * min_ratio
    reused = F.coalesce(checkpoint_present, F.lit(False)) & ~F.coalesce(checkpoint_reset, F.lit(False))
    cold = F.when(short_before, F.lit("artifact_incomplete")).otherwise(F.lit("ok"))
    crash = (
        F.when(short_before, F.lit("pre_fault_incomplete"))
        .when(short_after, F.lit("post_fault_incomplete"))
        .when(~reused, F.lit("checkpoint_missing"))
        .otherwise(F.lit("ok"))
    )
    return F.when(fault_kind == "none", cold).otherwise(crash)


def resolve_threshold(models: DataFrame, metrics: DataFrame, points: DataFrame, default: float = 0.5) -> DataFrame:
    """Threshold per (model, feature_set): last metrics row, else stored operating point, else the default.

    ``metrics(model, feature_set, opt_threshold, version)`` and ``points(model, feature_set, opt_threshold)``.
    """
    keys = ["model", "feature_set"]
    number = to_number(F.col("opt_threshold"))
    first = metrics.withColumns({"_t": number, "model": F.trim("model")}).where("_t is not null")
    first = first.groupBy(*keys).agg(F.max_by("_t", "version").alias("_first"))
    second = points.withColumn("_t", number).groupBy(*keys).agg(F.max("_t").alias("_second"))
    joined = models.join(first, keys, "left").join(second, keys, "left")
    return joined.withColumn("threshold", F.coalesce("_first", "_second", F.lit(float(default)))).drop("_first", "_second")
