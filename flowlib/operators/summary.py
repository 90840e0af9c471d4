"""Run summary rows and the report tables over repeated runs.

A summary holds one row per run, so its groups are as large as the number of repeats; the row-level
latencies the tables pool go through ``exact_percentiles``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlib.functions.text import format_fixed, format_mean_std, mode_label
from flowlib.functions.values import first_numeric, metric_phase, numeric_or_null
from flowlib.operators.arrivals import emit_gap_stats
from flowlib.operators.lag import backlog_summary, offset_lag
from flowlib.operators.latency import fault_phase_summary, first_emit_delay, latency_distribution, latency_summary
from flowlib.operators.ordered import join_same
from flowlib.operators.percentiles import exact_percentiles
from flowlib.operators.quality import prediction_quality, row_barrier
from flowlib.operators.rules import classify_overload, drain_barrier, evaluate_slo, recovery_status, source_stability, with_overload_ratios

QUALITY_FIELDS = ("quality_status", "precision", "recall", "f1", "fpr", "fnr")
DISTRIBUTION_FIELDS = ("avg", "min", "max", "q90", "q95", "q99")


def union_summary_rows(frames: list[DataFrame]) -> DataFrame:
    """Stack summaries with different columns; columns keep first-seen order, absent cells are null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_summary_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def upsert_summary(existing: DataFrame | None, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """History plus new rows with the last row per key; of equal versions the later frame wins.

    ``version`` orders rows inside a frame. Of rows of one key, frame and version (or without that column) the
    largest, column by column, stays, so the answer doesn't depend on partitioning. The newest row is an aggregate,
    combined before the shuffle.
    """
    parts = [new.withColumn("_part", F.lit(1))]
    if existing is not None:
        parts.insert(0, existing.withColumn("_part", F.lit(0)))
    rows = union_summary_rows(parts)
    columns = [c for c in rows.columns if c not in (*keys, "_part")]
    age = F.struct("_part", *([F.col("version")] if "version" in columns else []), *columns)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), age).alias("_row")).select(*keys, "_row.*")
    return newest.orderBy(*order) if order else newest


def mean_std(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, sample deviation (0.0 for a single value) and count of each metric per group; null keys are dropped."""
    out = []
    for m in metrics:
        v = numeric_or_null(df, m)
        n = F.count(v)
        out += [
            F.avg(v).alias(f"{m}_mean"),
            F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(v)).alias(f"{m}_std"),
            n.alias(f"{m}_n"),
        ]
    return df.dropna(subset=keys).groupBy(*keys).agg(*out)


def median_min_max(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Median, range and repeat count of each metric per group; null keys are dropped."""
    rows = df.dropna(subset=keys).select(*keys, *[numeric_or_null(df, m).alias(m) for m in metrics])
    ranges = [f(m).alias(f"{m}_{name}") for m in metrics for name, f in (("min", F.min), ("max", F.max))]
    counts = rows.groupBy(*keys).agg(*ranges, F.count("*").alias("repeat_count"))
    medians = exact_percentiles(rows, keys, {f"{m}_median": (m, 0.5) for m in metrics})
    return join_same(counts, medians, keys, "left")


def join_phase_summary(runs: DataFrame, phase_summary: DataFrame) -> DataFrame:
    """Run table with its phase summary; runs without one have nulls."""
    return join_same(runs, phase_summary, ["run_tag"], "left")


def run_summary(
    preds: DataFrame,
    samples: DataFrame,
    runs: DataFrame,
    phase: str = "measure",
    limits=None,
    target_rps: str = "target_rps",
    watermarks: DataFrame | None = None,
    expected: DataFrame | None = None,
    emits: DataFrame | None = None,
    control_tail_records: int = 0,
) -> DataFrame:
    """One wide row per run: latency, quality, backlog, service level and overload verdict.

    ``watermarks(run_tag, topic_partition, low, high)`` adds the lag at the end and the drain barrier, ``expected(run_tag,
    phase, expected)`` the row barrier of each phase it names, and ``emits(run_tag, emit_ts, due_ts, row_index)`` the pace
    of the source, whose instability then is a reason of failure.
    """
    wide = join_same(runs, latency_summary(preds, phase, runs), ["run_tag"], "left")
    quality = prediction_quality(preds, phase, runs).select("run_tag", *QUALITY_FIELDS)
    wide = join_same(wide, quality, ["run_tag"], "left")
    wide = join_same(wide, backlog_summary(samples), ["run_tag"], "left")
    if watermarks is not None:
        wide = drain_barrier(join_same(wide, offset_lag(preds, watermarks, phase, control_tail_records, ["run_tag"]), ["run_tag"], "left"))
    if expected is not None:
        wide = join_same(wide, barrier_columns(row_barrier(preds, expected)), ["run_tag"], "left")
    if emits is not None:
        wide = join_same(wide, source_columns(emits, runs, target_rps), ["run_tag"], "left")
    judged = evaluate_slo(wide, target_rps=target_rps, **({"limits": limits} if limits else {}))
    judged = with_overload_ratios(judged, target_rps)
    verdict = classify_overload(F.col("drain_throughput_ratio"), F.col("p95_e2e_ms"), F.col("kafka_lag_peak_ratio"))
    status = F.when(F.col("latency_status") == "ok", F.lit("ok")).otherwise(F.lit("artifact_missing"))
    return judged.withColumns({"degradation_status": verdict, "status": status})


def barrier_columns(barrier: DataFrame, phases: tuple[str, ...] = ("warmup", "measure")) -> DataFrame:
    """Row barriers of a run side by side: expected and actual rows and status of each phase; null for a phase not expected."""
    names = {"expected": "rows_expected", "actual": "rows_actual", "status": "barrier_status"}
    cells = [
        F.max(F.when(F.col("phase") == phase, F.col(column))).alias(f"{phase}_artifact_{name}") for phase in phases for column, name in names.items()
    ]
    return barrier.groupBy("run_tag").agg(*cells)


def source_columns(emits: DataFrame, runs: DataFrame, target_rps: str = "target_rps") -> DataFrame:
    """Pace of the source of each run, and whether it was ``ok`` or ``unstable`` and why."""
    names = {
        "actual_rps": "replay_actual_rps",
        "actual_elapsed_sec": "replay_actual_elapsed_sec",
        "emit_gap_p95_ms": "replay_emit_gap_p95_ms",
        "emit_gap_p99_ms": "replay_emit_gap_p99_ms",
        "emit_gap_max_ms": "replay_emit_gap_max_ms",
        "tick_lag_p95_ms": "replay_tick_lag_p95_ms",
        "tick_lag_max_ms": "replay_tick_lag_max_ms",
    }
    paced = emit_gap_stats(emits, ["run_tag"]).select("run_tag", *[F.col(c).alias(n) for c, n in names.items()])
    targets = runs.select("run_tag", numeric_or_null(runs, target_rps).alias("replay_target_rps"))
    both = join_same(paced, targets, ["run_tag"], "left")
    reason = source_stability(
        F.col("replay_target_rps"), F.col("replay_actual_rps"), F.col("replay_emit_gap_max_ms"), F.col("replay_tick_lag_max_ms"), F.lit(0)
    )
    both = both.withColumn("replay_failure_reason", reason)
    return both.withColumn("replay_status", F.when(F.col("replay_failure_reason") == "", F.lit("ok")).otherwise(F.lit("unstable")))


def model_feature_run_summary(preds: DataFrame, samples: DataFrame, runs: DataFrame, phase: str = "measure") -> DataFrame:
    """One row per run of a model and feature set: latency, quality and backlog under the names its report reads."""
    names = {
        "rows_total": "rows",
        "artifact_source_p95_ms": "source_p95_ms",
        "artifact_source_p99_ms": "source_p99_ms",
        "artifact_processing_p95_ms": "proc_p95_ms",
        "artifact_processing_p99_ms": "proc_p99_ms",
        "artifact_e2e_p95_ms": "e2e_p95_ms",
        "artifact_e2e_p99_ms": "e2e_p99_ms",
    }
    kept = ["run_tag", "latency_status", "artifact_rows_total", "drain_rps", *names]
    latency = latency_summary(preds, phase, runs).select(*kept).withColumnsRenamed(names)
    quality = prediction_quality(preds, phase, runs).select(
        "run_tag", *QUALITY_FIELDS, "scored_rows_total",
        F.col("avg_prediction_score_weighted").alias("avg_prediction_score"), F.col("attack_ratio_weighted").alias("attack_ratio"),
    )
    wide = join_same(join_same(runs, latency, ["run_tag"], "left"), quality, ["run_tag"], "left")
    wide = join_same(wide, backlog_summary(samples), ["run_tag"], "left")
    good = (F.col("latency_status") == "ok") | (F.col("quality_status") == "ok")
    return wide.withColumn("status", F.when(good, F.lit("ok")).otherwise(F.lit("quality_missing")))


def fault_run_summary(preds: DataFrame, samples: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per cold start or crash run: rows before and after, time to the first result, latency, backlog, verdict.

    ``runs`` states ``fault_kind``, ``initial_expected_rows``, ``post_fault_expected_rows``, ``started_epoch_ms``,
    ``restarted_epoch_ms``, ``checkpoint_present_before_restart`` and ``reset_outputs``.
    """
    cold = F.col("fault_kind") == "none"
    phase = metric_phase(F.col("benchmark_phase"))
    counts = preds.groupBy("run_tag").agg(F.count_if(phase == "cold_start").alias("_cold"), F.count_if(phase == "pre_fault").alias("_pre"))
    after = latency_summary(preds, "post_fault", runs).select(
        "run_tag",
        F.col("rows_total").alias("post_fault_rows"),
        F.col("drain_rps").alias("drain_rps_after_fault"),
        F.col("artifact_processing_p95_ms").alias("proc_p95_ms_after_fault"),
        F.col("artifact_e2e_p95_ms").alias("e2e_p95_ms_after_fault"),
    )
    startup = first_emit_delay(preds, runs.select("run_tag", F.col("started_epoch_ms").alias("since_epoch_ms")), "cold_start")
    recovery = first_emit_delay(preds, runs.select("run_tag", F.col("restarted_epoch_ms").alias("since_epoch_ms")), "post_fault")
    wide = join_same(runs, counts, ["run_tag"], "left")
    for part in (
        after,
        startup.withColumnRenamed("first_emit_delay_sec", "startup_seconds"),
        recovery.withColumnRenamed("first_emit_delay_sec", "recovery_seconds"),
        backlog_summary(samples),
    ):
        wide = join_same(wide, part, ["run_tag"], "left")
    initial = F.coalesce(F.when(cold, F.col("_cold")).otherwise(F.col("_pre")), F.lit(0))
    crash_only = ("post_fault_rows", "drain_rps_after_fault", "proc_p95_ms_after_fault", "e2e_p95_ms_after_fault", "recovery_seconds")
    wide = wide.withColumns(
        {
            "initial_rows": initial,
            "startup_seconds": F.when(cold, F.col("startup_seconds")),
            "kafka_lag_max_after_fault": F.col("kafka_lag_peak_records"),
            "checkpoint_reused": F.when(~cold, F.coalesce("checkpoint_present_before_restart", F.lit(False)) & ~F.coalesce("reset_outputs", F.lit(False))),
            **{c: F.when(~cold, F.col(c)) for c in crash_only},
        }
    ).drop("_cold", "_pre")
    status = recovery_status(
        F.col("fault_kind"), F.col("initial_rows"), F.col("initial_expected_rows"), F.col("post_fault_rows"),
        F.col("post_fault_expected_rows"), F.col("checkpoint_present_before_restart"), F.col("reset_outputs"),
    )
    wide = wide.withColumn("status", status)

    def shortfall(name: str, rows: str, expected: str) -> Column:
        seen = F.coalesce(F.col(rows), F.lit(0)).cast("bigint").cast("string")
        return F.concat(F.lit(f"{name}="), seen, F.lit(" expected="), F.col(expected).cast("bigint").cast("string"))

    notes = (
        F.when(F.col("status") == "artifact_incomplete", shortfall("cold_start_rows", "initial_rows", "initial_expected_rows"))
        .when(F.col("status") == "pre_fault_incomplete", shortfall("pre_fault_rows", "initial_rows", "initial_expected_rows"))
        .when(F.col("status") == "post_fault_incomplete", shortfall("post_fault_rows", "post_fault_rows", "post_fault_expected_rows"))
        .when(F.col("status") == "checkpoint_missing", F.lit("checkpoint was not present before restart"))
        .otherwise(F.lit(""))
    )
    return wide.withColumn("notes", notes)


def _distribution_text() -> list[Column]:
    texts = [format_fixed(F.col(f"latency_{f}_ms")).alias(f"e2e_latency_{f}_ms") for f in DISTRIBUTION_FIELDS]
    return [format_fixed(F.col("latency_rows"), 0).alias("latency_rows"), *texts]


def _metric_texts(metrics: dict[str, tuple[str, int]]) -> list[Column]:
    return [
        format_mean_std(F.col(f"{column}_mean"), F.col(f"{column}_std"), decimals).alias(f"{name}_mean_std")
        for name, (column, decimals) in metrics.items()
    ]


def _table(runs: DataFrame, preds: DataFrame, keys: list[str], metrics: dict[str, tuple[str, int]], **how) -> DataFrame:
    stats = mean_std(runs, keys, sorted({column for column, _ in metrics.values()}))
    return join_same(stats, latency_distribution(preds, runs, keys, **how), keys, "left")


def capacity_summary(runs: DataFrame, preds: DataFrame) -> DataFrame:
    """By mode and target rate: pooled latency, and mean and deviation of the run figures, as text."""
    keys = ["mode", "target_rps"]
    metrics = {
        "p95_latency_ms": ("p95_e2e_ms", 1),
        "p99_latency_ms": ("p99_e2e_ms", 1),
        "drain_rps": ("drain_rps", 1),
        "throughput_ratio": ("throughput_ratio", 3),
        "kafka_lag_peak": ("kafka_lag_peak_records", 0),
    }
    table = _table(runs, preds, keys, metrics)
    return table.select(
        mode_label(F.col("mode")).alias("mode"), format_fixed(F.col("target_rps"), 0).alias("target_rps"),
        *_distribution_text(), *_metric_texts(metrics),
    ).orderBy("mode", "target_rps")


def model_feature_summary(runs: DataFrame, preds: DataFrame) -> DataFrame:
    """By candidate, feature set and target rate: pooled latency, run figures and quality, as text."""
    keys = ["candidate_label", "feature_set", "target_rps"]
    metrics = {
        "p95_latency_ms": ("e2e_p95_ms", 1),
        "p99_latency_ms": ("e2e_p99_ms", 1),
        "drain_rps": ("drain_rps", 1),
        "kafka_lag_peak": ("kafka_lag_peak_records", 0),
        "precision": ("precision", 4),
        "recall": ("recall", 4),
        "f1": ("f1", 4),
    }
    table = _table(runs, preds, keys, metrics)
    return table.select(
        F.col("candidate_label").alias("candidate"), "feature_set", format_fixed(F.col("target_rps"), 0).alias("target_rps"),
        *_distribution_text(), *_metric_texts(metrics),
    ).orderBy("candidate")


def _share_text(hits: str, total: str) -> Column:
    return F.concat(F.col(hits).cast("string"), F.lit("/"), F.col(total).cast("string"))


def fault_recovery_summary(runs: DataFrame, preds: DataFrame) -> DataFrame:
    """By scenario and target rate: rows, recovery time, latency of the phase that counts, backlog, checkpoint reuse."""
    keys = ["scenario", "target_rps"]
    data = join_phase_summary(runs, fault_phase_summary(preds, runs))
    data = data.withColumns(
        {
            "phase_p95_latency_ms": first_numeric(data, "phase_e2e_p95_ms", "e2e_p95_ms_after_fault"),
            "phase_drain_rps": first_numeric(data, "phase_output_rps", "drain_rps_after_fault"),
            "rows_expected": first_numeric(data, "post_fault_expected_rows", "initial_expected_rows"),
            "rows_observed": first_numeric(data, "post_fault_rows", "initial_rows"),
            "startup_or_recovery_sec": first_numeric(data, "startup_seconds", "recovery_seconds"),
        }
    )
    reused = F.lower(F.col("checkpoint_reused").cast("string")) == "true" if "checkpoint_reused" in data.columns else F.lit(False)
    metrics = {
        "rows_expected": ("rows_expected", 0),
        "rows_observed": ("rows_observed", 0),
        "startup_or_recovery_sec": ("startup_or_recovery_sec", 1),
        "phase_p95_latency_ms": ("phase_p95_latency_ms", 1),
        "phase_drain_rps": ("phase_drain_rps", 1),
        "kafka_lag_peak": ("kafka_lag_peak_records", 0),
        "kafka_lag_clear_sec": ("kafka_lag_clear_sec", 1),
    }
    table = _table(data, preds, keys, metrics, phase_by_fault_kind=True)
    hits = data.dropna(subset=keys).groupBy(*keys).agg(F.count_if(reused).alias("_hits"), F.count("*").alias("_runs"))
    return join_same(table, hits, keys, "left").select(
        "scenario", format_fixed(F.col("target_rps"), 0).alias("target_rps"),
        *_distribution_text(), *_metric_texts(metrics), _share_text("_hits", "_runs").alias("checkpoint_reused"),
    ).orderBy("target_rps", "scenario")


def overload_summary(runs: DataFrame, preds: DataFrame) -> DataFrame:
    """By target rate: overloaded runs, pooled latency, run figures and highest peak lag, as text."""
    keys = ["target_rps"]
    metrics = {
        "p95_latency_ms": ("p95_e2e_ms", 1),
        "p99_latency_ms": ("p99_e2e_ms", 1),
        "drain_rps": ("drain_rps", 1),
        "target_to_drain_ratio": ("target_to_drain_ratio", 3),
        "kafka_lag_peak": ("kafka_lag_peak_records", 0),
        "kafka_lag_clear_sec": ("kafka_lag_clear_sec", 1),
    }
    table = _table(runs, preds, keys, metrics)
    extra = runs.dropna(subset=keys).groupBy(*keys).agg(
        F.count_if(F.col("degradation_status") == "overloaded").alias("_hits"),
        F.count("*").alias("_runs"),
        F.max(numeric_or_null(runs, "kafka_lag_peak_records")).alias("_peak"),
    )
    return join_same(table, extra, keys, "left").select(
        format_fixed(F.col("target_rps"), 0).alias("target_rps"), _share_text("_hits", "_runs").alias("overloaded"),
        *_distribution_text(), *_metric_texts(metrics), format_fixed(F.col("_peak"), 0).alias("kafka_lag_peak_max"),
    ).orderBy("target_rps")


# Printed where no run states the setting.
CONFIGURATION_DEFAULTS = {
    "spark_master": "local[4]",
    "trigger_interval": "1 second",
    "max_offsets_per_trigger": "1000",
    "shuffle_partitions": "4",
    "topic_partitions": "1",
}


def selected_configuration(
    capacity: DataFrame, fallback: DataFrame, environment: dict[str, str], order: str = "run_tag", mode: str = "random_forest_full",
    target_rps: float = 500,
) -> DataFrame:
    """Settings of the operating point: first stated value by ``order``; without such a run, those of ``fallback``.

    ``environment`` holds what no run states (machines, main model, rates to show) and is added as given.
    """
    chosen = capacity.where((F.col("mode") == mode) & (numeric_or_null(capacity, "target_rps") == target_rps))

    def settings(df: DataFrame, preferred: bool) -> DataFrame:
        cells = [(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in CONFIGURATION_DEFAULTS]
        return df.select(F.lit(preferred).alias("_a"), F.col(order).alias("_order"), *cells)

    rows = settings(chosen, True).unionByName(settings(fallback, False))
    firsts = [F.count_if("_a").alias("a_n")]
    for c in CONFIGURATION_DEFAULTS:
        for prefix, mine in (("a_", F.col("_a")), ("b_", ~F.col("_a"))):
            at = F.when(mine & F.col(c).isNotNull(), F.col("_order"))
            firsts.append(F.min_by(F.col(c), at).alias(f"{prefix}{c}"))
    both = rows.agg(*firsts)
    cells = {c: F.when(F.col("a_n") > 0, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")) for c in CONFIGURATION_DEFAULTS}
    return both.select(
        *[F.coalesce(cells[c], F.lit(d)).alias("kafka_partitions" if c == "topic_partitions" else c) for c, d in CONFIGURATION_DEFAULTS.items()],
        *[F.lit(v).alias(k) for k, v in environment.items()],
    )
