"""Latency sketches that are stored once per run, phase and second, and merged into reports without the rows.

A KLL sketch of a few KB stands for any number of latencies, and sketches of parts merge into that of the whole. Reports over repeats, phases
or spans of time read one sketch row per second of a run instead of every prediction. A quantile's rank is off by at
most ``rank_error`` of the rows, with a probability over 99 %, whatever was merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlib.functions.values import DEFAULT_PHASE, numeric_or_null
from flowlib.operators.latency import LATENCIES
from flowlib.operators.ordered import join_same
from flowlib.scratch import small_side

#: Size parameter of a sketch: more is more exact and larger.
K = 1024


def rank_error(k: int = K) -> float:
    """Bound of the normalized rank error of a single quantile, the sketch's documented 2.296 / k^0.9021."""
    return 2.296 / k**0.9021


def latency_sketches(preds: DataFrame, k: int = K) -> DataFrame:
    """Per run, phase and whole second since the run's first emit: rows, range, sum and a sketch of each latency that occurs."""
    emitted = preds.where("emit_time is not null")
    starts = emitted.groupBy("run_tag").agg(F.min("emit_time").alias("_start"))
    placed = join_same(emitted, small_side(starts), ["run_tag"], "inner")
    second = F.floor((F.unix_micros("emit_time") - F.unix_micros("_start")) / 1e6).alias("second")
    phase = F.coalesce("benchmark_phase", F.lit(DEFAULT_PHASE)).alias("benchmark_phase")
    rows = placed.select("run_tag", phase, second, *[numeric_or_null(placed, c).alias(name) for name, c in LATENCIES.items()])
    cells: list[Column] = [F.count("*").alias("rows")]
    for name in LATENCIES:
        value = F.col(name)
        cells += [
            F.count(value).alias(f"{name}_n"), F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max"), F.sum(value).alias(f"{name}_sum"),
            F.kll_sketch_agg_double(value, F.lit(k)).alias(f"{name}_sketch"),
        ]
    return rows.groupBy("run_tag", "benchmark_phase", "second").agg(*cells)


def merged_latencies(sketches: DataFrame, keys: list[str], quantiles: tuple[float, ...] = (0.5, 0.95, 0.99), k: int = K) -> DataFrame:
    """Per group of sketch rows: rows, and of each latency its number, mean, range and quantiles."""
    cells: list[Column] = [F.sum("rows").alias("rows")]
    for name in LATENCIES:
        held = F.when(F.col(f"{name}_n") > 0, F.col(f"{name}_sketch"))
        cells += [
            F.sum(f"{name}_n").alias(f"{name}_n"), F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_n")).alias(f"{name}_avg_ms"), F.min(f"{name}_min").alias(f"{name}_min_ms"),
            F.max(f"{name}_max").alias(f"{name}_max_ms"), F.kll_merge_agg_double(held, F.lit(k)).alias(f"_{name}"),
        ]
    merged = sketches.groupBy(*keys).agg(*cells)
    points = F.array(*[F.lit(float(q)) for q in quantiles])
    for name in LATENCIES:
        found = F.when(F.col(f"{name}_n") > 0, F.kll_sketch_get_quantile_double(F.col(f"_{name}"), points))
        merged = merged.withColumn(f"_{name}", found)
        merged = merged.withColumns({f"{name}_q{int(q * 100)}_ms": F.get(F.col(f"_{name}"), F.lit(i)) for i, q in enumerate(quantiles)}).drop(f"_{name}")
    return merged


def observed_rank_error(values: DataFrame, keys: list[str], value: str, estimates: DataFrame, column: str, q: float) -> DataFrame:
    """Per group, how far the share of values at or below an estimate is from ``q``; 0 where a tie covers ``q``."""
    rows = join_same(values.select(*keys, F.col(value).alias("_v")), small_side(estimates.select(*keys, F.col(column).alias("_estimate"))), keys, "inner")
    n = F.count("_v")
    below, upto = (F.try_divide(F.count_if(c), n) for c in (F.col("_v") < F.col("_estimate"), F.col("_v") <= F.col("_estimate")))
    return rows.groupBy(*keys).agg(F.when(n > 0, F.greatest(below - q, q - upto, F.lit(0.0))).alias("rank_error"))
