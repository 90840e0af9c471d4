"""Backlog of a topic: offsets, peak, lag at the end of input, time to clear, area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlib.functions.values import DEFAULT_PHASE, in_phase
from flowlib.operators.ordered import join_same, with_previous

REPLAY_END = "measure_replay_end"


def max_offset_per_partition(preds: DataFrame, phase: str | None = DEFAULT_PHASE, keys: list[str] | None = None) -> DataFrame:
    """Highest processed offset of each partition in a phase."""
    rows = preds.where(in_phase(preds, phase)).select(
        *(keys or []), F.col("kafka_partition").try_cast("int").alias("kafka_partition"), F.col("kafka_offset").try_cast("bigint").alias("_o")
    ).dropna(subset=["kafka_partition", "_o"])
    return rows.groupBy(*(keys or []), "kafka_partition").agg(F.max("_o").alias("max_offset"))


def offset_lag(
    preds: DataFrame, watermarks: DataFrame, phase: str | None = DEFAULT_PHASE, control_tail_records: int = 0, keys: list[str] | None = None
) -> DataFrame:
    """Lag at the end of a run over the partitions that have predictions; ``watermarks(topic_partition, low, high)``.

    With ``keys`` (such as ``run_tag``), which both sides then carry, there is one row per group of the watermarks, all
    groups in one pass; a group without predictions is ``artifact_offsets_missing``.
    """
    keys, tail = keys or [], max(int(control_tail_records), 0)
    seen = max_offset_per_partition(preds, phase, keys).withColumnRenamed("kafka_partition", "topic_partition")
    # A full join: groups without predictions stay, and so do predictions on partitions the watermarks lack.
    both = watermarks.select(*keys, "topic_partition", "high").join(seen, [*keys, "topic_partition"], "full")
    done = F.col("max_offset").isNotNull()
    raw = F.coalesce(F.sum(F.when(done, F.greatest(F.col("high") - 1 - F.col("max_offset"), F.lit(0)))), F.lit(0))
    out = both.groupBy(*keys).agg(
        raw.alias("_raw"), F.count_if(done).alias("kafka_lag_partitions"), F.max(F.when(done, F.col("high"))).alias("kafka_high_watermark_max")
    )
    none = F.col("kafka_lag_partitions") == 0
    return out.select(
        *keys,
        F.when(none, F.lit("artifact_offsets_missing")).otherwise(F.lit("ok")).alias("kafka_lag_status"),
        F.when(~none, F.greatest(F.col("_raw") - tail, F.lit(0))).alias("kafka_lag_records_end"),
        F.when(~none, F.col("_raw")).alias("kafka_lag_records_raw_end"),
        F.when(~none, F.lit(tail)).alias("kafka_control_tail_records"),
        "kafka_lag_partitions",
        "kafka_high_watermark_max",
    )


def sampler_lag(preds: DataFrame, watermarks: DataFrame, control_tail_records: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Lag over all topic partitions; a partition without predictions counts from its low watermark.

    With ``keys``, which both sides then carry, one row per group of the watermarks.
    """
    keys = keys or []
    done = max_offset_per_partition(preds, None, keys).withColumnRenamed("kafka_partition", "topic_partition")
    all_parts = join_same(watermarks, done, [*keys, "topic_partition"], "left")
    processed = F.coalesce(F.col("max_offset"), F.col("low") - 1)
    out = all_parts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.greatest(F.col("high") - (processed + 1), F.lit(0))), F.lit(0)).alias("raw_lag_records"),
        F.coalesce(F.max("high"), F.lit(0)).alias("high_watermark_max"),
        F.coalesce(F.max(processed), F.lit(-1)).alias("processed_offset_max"),
        F.count("*").alias("partition_count"),
    )
    status = F.when(F.col("partition_count") == 0, F.lit("topic_partitions_missing")).otherwise(F.lit("ok"))
    lag = F.greatest(F.col("raw_lag_records") - F.lit(int(control_tail_records)), F.lit(0))
    return out.withColumns({"lag_records": lag, "status": status})


def measure_samples(samples: DataFrame) -> DataFrame:
    """Good samples of the measured phases."""
    return samples.where(F.coalesce(F.col("phase"), F.lit("")).startswith("measure") & (F.col("status") == "ok") & F.col("lag_records").isNotNull())


def replay_end(samples: DataFrame) -> DataFrame:
    """First end-of-input sample of each run: its time and lag."""
    ends = samples.where(F.col("event") == REPLAY_END)
    return ends.groupBy("run_tag").agg(
        F.min("ts_epoch_ms").alias("end_ms"), F.min_by("lag_records", "ts_epoch_ms").alias("end_lag")
    )


def lag_summary(samples: DataFrame) -> DataFrame:
    """Samples, first peak and its phase, lag at the end of input and last lag of each run, in one aggregation."""
    good = F.col("phase").startswith("measure") & (F.col("status") == "ok") & F.col("lag_records").isNotNull()
    good = F.coalesce(good, F.lit(False))
    # The first of equal peaks wins: order by lag, then by earlier time.
    peak = F.when(good, F.struct(F.col("lag_records"), (-F.col("ts_epoch_ms")).alias("neg_ts")))
    ended = F.col("event") == REPLAY_END
    return samples.groupBy("run_tag").agg(
        F.count("*").alias("kafka_lag_samples"),
        F.max(F.when(good, F.col("lag_records"))).alias("kafka_lag_peak_records"),
        F.max_by(F.when(good, F.col("phase")), peak).alias("kafka_lag_peak_phase"),
        F.min_by(F.when(ended, F.col("lag_records")), F.when(ended, F.col("ts_epoch_ms"))).alias("kafka_lag_at_replay_end_records"),
        F.max_by(F.when(good, F.col("lag_records")), F.when(good, F.col("ts_epoch_ms"))).alias("kafka_lag_end_after_drain_records"),
    )


def lag_clear_seconds(samples: DataFrame) -> DataFrame:
    """Seconds from the end of input to the first empty sample; 0 if already empty, null if never."""
    ends = replay_end(samples)
    placed = join_same(measure_samples(samples), ends, ["run_tag"], "inner")
    empty = (F.col("ts_epoch_ms") >= F.col("end_ms")) & (F.col("lag_records") <= 0)
    cleared = placed.groupBy("run_tag").agg(F.min(F.when(empty, F.col("ts_epoch_ms"))).alias("_cleared"))
    both = join_same(ends, cleared, ["run_tag"], "left")
    seconds = F.when(F.col("end_lag") <= 0, F.lit(0.0)).when(
        F.col("end_lag").isNotNull(), (F.col("_cleared") - F.col("end_ms")) / 1000.0
    )
    every = samples.select("run_tag").distinct()
    return join_same(every, both.select("run_tag", seconds.alias("kafka_lag_clear_sec")), ["run_tag"], "left")


def lag_area(samples: DataFrame) -> DataFrame:
    """Sum of elapsed seconds times the previous lag over the measured samples; null below two samples."""
    rows = measure_samples(samples).select("run_tag", "ts_epoch_ms", "lag_records")
    steps = with_previous(rows, ["run_tag"], ["ts_epoch_ms", "lag_records"], {"_ts": "ts_epoch_ms", "_lag": "lag_records"})
    step = F.greatest((F.col("ts_epoch_ms") - F.col("_ts")) / 1000.0, F.lit(0.0)) * F.col("_lag")
    areas = steps.groupBy("run_tag").agg(F.sum(step).alias("kafka_lag_area_records_sec"))
    return join_same(samples.select("run_tag").distinct(), areas, ["run_tag"], "left")


def backlog_summary(samples: DataFrame) -> DataFrame:
    """All backlog figures of each run."""
    out = join_same(lag_summary(samples), lag_clear_seconds(samples), ["run_tag"], "left")
    return join_same(out, lag_area(samples), ["run_tag"], "left").withColumn("kafka_lag_sampler_status", F.lit("ok"))


def rebase_lag_series(samples: DataFrame) -> DataFrame:
    """Measured lag by whole second since the run's first measured sample."""
    rows = samples.where(F.lower("phase").startswith("measure")).select(
        "run_tag", F.col("ts_epoch_ms").cast("double").alias("_ms"), F.col("lag_records").cast("double").alias("value")
    ).dropna(subset=["_ms", "value"])
    starts = rows.groupBy("run_tag").agg(F.min("_ms").alias("_start"))
    second = F.floor((F.col("_ms") - F.col("_start")) / 1000.0)
    return join_same(rows, starts, ["run_tag"], "inner").select("run_tag", second.alias("second"), "value")
