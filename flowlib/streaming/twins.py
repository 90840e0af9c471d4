"""Streaming forms of batch operators: late label join and latency per second."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlib.functions.values import DEFAULT_PHASE
from flowlib.streaming.closing import CONTROL, until_end


def stream_label_join(preds: DataFrame, inputs: DataFrame, delay: str = "1 hour", how: str = "leftOuter", closing: bool = False) -> DataFrame:
    """Predictions with labels that arrive within ``delay``, matched on (partition, offset).

    Both watermarks bound the state. An unmatched prediction is emitted, without a label, once the
    watermark has passed it; the last ones stay in state when a bounded run ends, unless both streams are
    ``closing``, that is, end with an end-of-input record.
    """
    watch = until_end if closing else DataFrame.withWatermark
    ends = [F.col(CONTROL)] if closing else []
    left = watch(preds.drop("label_binary", "label"), "emit_time", delay)
    right = watch(
        inputs.select(F.col("kafka_partition").alias("_p"), F.col("kafka_offset").alias("_o"), F.col("event_time").alias("_at"), "label_binary", "label", *ends), "_at", delay
    )
    bound = F.expr(f"_at >= emit_time - interval {delay} and _at <= emit_time + interval {delay}")
    match = (left.kafka_partition == right._p) & (left.kafka_offset == right._o) & bound
    return left.join(right, match, how).drop("_p", "_o", "_at")


def latency_by_window(preds: DataFrame, width: str = "1 second", watermark: str | None = None, closing: bool = False) -> DataFrame:
    """Rows and end-to-end percentiles per run, phase and emit window.

    With a watermark the percentiles are approximate sketches of bounded size; use append mode. The last windows
    come out of a ``closing`` stream, one that ends with an end-of-input record.
    """
    rows = (until_end if closing else DataFrame.withWatermark)(preds, "emit_time", watermark) if watermark else preds
    phase = F.coalesce("benchmark_phase", F.lit(DEFAULT_PHASE)).alias("benchmark_phase")
    grouped = rows.groupBy("run_tag", phase, F.window("emit_time", width).alias("_w"))
    quantiles = F.percentile_approx("end_to_end_ms", [0.5, 0.95, 0.99], 10_000)
    out = grouped.agg(F.count("*").alias("rows"), F.max("end_to_end_ms").alias("e2e_max_ms"), quantiles.alias("_q"))
    return out.select(
        "run_tag", "benchmark_phase", F.col("_w.start").alias("window_start"), "rows", "e2e_max_ms",
        *[F.col("_q")[i].alias(n) for i, n in enumerate(("e2e_p50_ms", "e2e_p95_ms", "e2e_p99_ms"))],
    )
