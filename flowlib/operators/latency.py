"""Latency and throughput of prediction artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlib.functions.text import short_run_label
from flowlib.functions.values import DEFAULT_PHASE, in_phase, metric_phase, numeric_or_null, span_seconds
from flowlib.operators.ordered import join_same, with_row_number
from flowlib.operators.percentiles import percentiles
from flowlib.scratch import small_side

LATENCIES = {"source": "source_to_ingest_ms", "processing": "processing_ms", "e2e": "end_to_end_ms"}


def latency_summary(
    preds: DataFrame,
    phase: str | None = "measure",
    runs: DataFrame | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """Rows, p50/p95/p99 of the three latencies, emit span and drain rate of each run in a phase.

    ``drain_rps`` divides all rows of the phase by the emit span; both are null when the span is not
    positive. ``runs`` lists the runs to report; one without any prediction is ``latency_missing``. Percentiles
    are exact unless an ``accuracy`` asks for sketches.
    """
    inside = in_phase(preds, phase)
    emit = F.when(inside, F.col("emit_time"))
    span = span_seconds(F.min(emit), F.max(emit))
    counts = preds.groupBy("run_tag").agg(F.count_if(inside).alias("_rows"), span.alias("_span"))
    if runs is not None:
        counts = runs.select("run_tag").distinct().join(counts, "run_tag", "left")
    wanted = {
        f"artifact_{name}_p{int(q * 100)}_ms": (column, q) for name, column in LATENCIES.items() for q in (0.50, 0.95, 0.99)
    }
    ranks = percentiles(preds.where(inside), ["run_tag"], wanted, accuracy)
    rows = F.coalesce(F.col("_rows"), F.lit(0))
    wall = F.when((rows > 0) & (F.col("_span") > 0), F.col("_span"))
    status = (
        F.when(F.col("_rows").isNull(), F.lit("latency_missing"))
        .when(F.col("_rows") == 0, F.lit("no_predictions"))
        .otherwise(F.lit("ok"))
    )
    base = counts.select(
        "run_tag",
        status.alias("latency_status"),
        rows.alias("artifact_rows_total"),
        F.when(rows > 0, rows).alias("rows_total"),
        wall.alias("measure_wall_clock_sec"),
        (rows / wall).alias("drain_rps"),
    )
    return join_same(base, ranks, ["run_tag"], "left")


def latency_timeseries(preds: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Rows, rate and percentiles per run, phase (as written) and whole second since the run's first emit."""
    emitted = preds.where("emit_time is not null")
    starts = emitted.groupBy("run_tag").agg(F.min("emit_time").alias("_start"))
    placed = join_same(emitted, small_side(starts), ["run_tag"], "inner")
    second = F.floor((F.unix_micros("emit_time") - F.unix_micros("_start")) / 1e6)
    rows = placed.select(
        "run_tag",
        F.coalesce("benchmark_phase", F.lit(DEFAULT_PHASE)).alias("benchmark_phase"),
        second.alias("second"),
        *LATENCIES.values(),
    )
    keys = ["run_tag", "benchmark_phase", "second"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    wanted = {
        "source_p95_ms": ("source_to_ingest_ms", 0.95),
        "processing_p50_ms": ("processing_ms", 0.50),
        "processing_p95_ms": ("processing_ms", 0.95),
        "e2e_p50_ms": ("end_to_end_ms", 0.50),
        "e2e_p95_ms": ("end_to_end_ms", 0.95),
        "e2e_p99_ms": ("end_to_end_ms", 0.99),
    }
    ranks = percentiles(rows, keys, wanted, accuracy)
    counts = counts.withColumn("throughput_rps", F.col("rows").cast("double"))
    return join_same(counts, ranks, keys, "left")


def export_latency_timeseries(preds: DataFrame, path: str) -> DataFrame:
    """Write the series of all runs, partitioned by run; returns the manifest: run, path, rows, status."""
    latency_timeseries(preds).write.mode("overwrite").partitionBy("run_tag").parquet(path)
    written = preds.sparkSession.read.parquet(path).groupBy("run_tag").agg(F.sum("rows").alias("rows"))
    where = F.concat(F.lit(f"{path}/run_tag="), F.col("run_tag"))
    return written.select("run_tag", where.alias("latency_timeseries_path"), "rows", F.lit("ok").alias("status"))


def fault_phase(fault_kind):
    """Phase that counts for a fault run: ``cold_start`` without a fault, else ``post_fault``."""
    return F.when(F.coalesce(fault_kind, F.lit("")) == "none", F.lit("cold_start")).otherwise(F.lit("post_fault"))


def latency_distribution(
    preds: DataFrame,
    runs: DataFrame,
    group: list[str],
    phase: str | None = DEFAULT_PHASE,
    phase_by_fault_kind: bool = False,
    accuracy: int | None = None,
) -> DataFrame:
    """End-to-end latency pooled over the repeats of each group of runs: rows, mean, range and q90/q95/q99."""
    wanted_phase = fault_phase(F.col("fault_kind")) if phase_by_fault_kind else F.lit(phase)
    members = small_side(runs.dropna(subset=group).select("run_tag", *group, wanted_phase.alias("_phase")))
    rows = join_same(preds.select("run_tag", "benchmark_phase", numeric_or_null(preds, "end_to_end_ms").alias("_ms")), members, ["run_tag"], "inner")
    rows = rows.where("_ms is not null")
    if phase_by_fault_kind or phase is not None:
        rows = rows.where(metric_phase(F.col("benchmark_phase")) == F.lower("_phase"))
    stats = rows.groupBy(*group).agg(
        F.count("*").alias("latency_rows"),
        F.avg("_ms").alias("latency_avg_ms"),
        F.min("_ms").alias("latency_min_ms"),
        F.max("_ms").alias("latency_max_ms"),
    )
    wanted = {f"latency_q{int(q * 100)}_ms": ("_ms", q) for q in (0.90, 0.95, 0.99)}
    return join_same(stats, percentiles(rows, group, wanted, accuracy), group, "left")


def pool_runs(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """One metric of several run artifacts stacked; an artifact that lacks a column has nulls there."""
    out = None
    for frame in frames:
        part = frame.select(*[c for c in columns if c in frame.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def first_emit_delay(preds: DataFrame, starts: DataFrame, phase: str) -> DataFrame:
    """Seconds from ``since_epoch_ms`` (per run) to the first emit of a phase, never below 0, null without an emit."""
    first = preds.where(in_phase(preds, phase)).groupBy("run_tag").agg(F.min("emit_time").alias("_first"))
    delay = F.greatest((F.unix_millis("_first") - F.col("since_epoch_ms")) / 1000.0, F.lit(0.0))
    delay = F.when(F.col("_first").isNotNull(), delay)
    return starts.join(first, "run_tag", "left").select("run_tag", delay.alias("first_emit_delay_sec"))


def fault_phase_summary(preds: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run, p95 and rate of the phase that counts for its fault kind; only rows with a latency are counted."""
    members = small_side(runs.select("run_tag", fault_phase(F.col("fault_kind")).alias("_phase")))
    rows = join_same(preds, members, ["run_tag"], "inner").where(metric_phase(F.col("benchmark_phase")) == F.col("_phase"))
    rows = rows.select("run_tag", "emit_time", numeric_or_null(preds, "end_to_end_ms").alias("_ms"))
    span = span_seconds(F.min("emit_time"), F.max("emit_time"))
    rates = rows.groupBy("run_tag").agg(F.count("_ms").alias("_n"), span.alias("_span")).where("_n > 0")
    rates = rates.select("run_tag", F.when(F.col("_span") > 0, F.col("_n") / F.col("_span")).alias("phase_output_rps"))
    ranks = percentiles(rows.where("_ms is not null"), ["run_tag"], {"phase_e2e_p95_ms": ("_ms", 0.95)})
    return join_same(rates, ranks, ["run_tag"], "left")


def mean_series_by_second(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean over runs of ``value`` at each second."""
    return series.groupBy(*(keys or []), "second").agg(F.avg("value").alias("value"))


def rebase_latency_series(series: DataFrame, metric: str) -> DataFrame:
    """Measure-phase seconds of each run counted from its first one."""
    rows = series.where(F.lower("benchmark_phase").contains(DEFAULT_PHASE)).select(
        "run_tag", numeric_or_null(series, "second").cast("long").alias("second"), numeric_or_null(series, metric).alias("value")
    ).dropna(subset=["second", "value"])
    starts = rows.groupBy("run_tag").agg(F.min("second").alias("_start"))
    return join_same(rows, small_side(starts), ["run_tag"], "inner").select("run_tag", (F.col("second") - F.col("_start")).alias("second"), "value")


def empirical_cdf(df: DataFrame, keys: list[str], value: str, unique: str) -> DataFrame:
    """Sorted values with ``cdf = position / n`` per group; equal values get distinct heights, by ``unique``."""
    rows = df.select(*keys, F.col(value).cast("double").alias("value"), F.col(unique).alias("_id"))
    rows = rows.where("value is not null and not isnan(value)")
    placed = with_row_number(rows, keys, ["value", "_id"], name="_rn", total="_n")
    return placed.select(*keys, "value", (F.col("_rn") / F.col("_n")).alias("cdf"))


def with_short_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", short_run_label(F.col("run_tag")))
