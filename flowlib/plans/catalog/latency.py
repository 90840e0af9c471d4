"""Latency, throughput and backlog queries."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlib.functions.values import in_phase
from flowlib.operators import lag, latency, sketches
from flowlib.operators.percentiles import exact_percentiles
from flowlib.plans import views
from flowlib.plans.registry import query
from flowlib.scratch import new_path, stored

_Q = [(n, c, q) for n, c in (("source", "source_to_ingest_ms"), ("processing", "processing_ms"), ("e2e", "end_to_end_ms")) for q in (0.5, 0.95, 0.99)]
LATENCY_FLOATS = " ".join([*[f"artifact_{n}_p{int(q * 100)}_ms" for n, _, q in _Q], "drain_rps", "measure_wall_clock_sec"])
LATENCY_SQL = f"""
SELECT run_tag, CASE WHEN n IS NULL THEN 'no_predictions' ELSE 'ok' END AS latency_status, coalesce(n, 0) AS artifact_rows_total, n AS rows_total,
  CASE WHEN span > 0 THEN span END AS measure_wall_clock_sec, n / CASE WHEN span > 0 THEN span END AS drain_rps, {', '.join(f'artifact_{n}_p{int(q * 100)}_ms' for n, _, q in _Q)}
FROM (SELECT DISTINCT run_tag FROM preds) LEFT JOIN (SELECT run_tag, count(*) AS n, (epoch_us(max(emit_time)) - epoch_us(min(emit_time))) / 1e6::DOUBLE AS span,
    {', '.join(f'quantile_cont({c}, {q}::DOUBLE) AS artifact_{n}_p{int(q * 100)}_ms' for n, c, q in _Q)}
  FROM preds WHERE lower(coalesce(benchmark_phase, 'measure')) = 'measure' GROUP BY 1) USING (run_tag)"""


@query("latency_summary", sql=LATENCY_SQL, floats=LATENCY_FLOATS)
def latency_summary(spark, sf):
    return latency.latency_summary(views.preds(spark, sf))


@query("latency_summary_selected", sql=LATENCY_SQL, floats=LATENCY_FLOATS)
def latency_summary_selected(spark, sf):
    """The same answer from latencies that come as text."""
    rows = views.preds(spark, sf)
    return latency.latency_summary(rows.withColumns({c: F.col(c).cast("string") for c in latency.LATENCIES.values()}))


@query("latency_timeseries", sql="""
SELECT run_tag, coalesce(benchmark_phase, 'measure') AS benchmark_phase, ((epoch_us(emit_time) - epoch_us(s)) // 1000000)::BIGINT AS second, count(*) AS rows,
  count(*)::DOUBLE AS throughput_rps, quantile_cont(source_to_ingest_ms, 0.95::DOUBLE) AS source_p95_ms, quantile_cont(processing_ms, 0.5::DOUBLE) AS processing_p50_ms,
  quantile_cont(processing_ms, 0.95::DOUBLE) AS processing_p95_ms, quantile_cont(end_to_end_ms, 0.5::DOUBLE) AS e2e_p50_ms, quantile_cont(end_to_end_ms, 0.95::DOUBLE) AS e2e_p95_ms,
  quantile_cont(end_to_end_ms, 0.99::DOUBLE) AS e2e_p99_ms
FROM (SELECT *, min(emit_time) OVER (PARTITION BY run_tag) AS s FROM preds) GROUP BY 1, 2, 3""",
       floats="source_p95_ms processing_p50_ms processing_p95_ms e2e_p50_ms e2e_p95_ms e2e_p99_ms")
def latency_timeseries(spark, sf):
    return latency.latency_timeseries(views.preds(spark, sf))


@query("latency_timeseries_manifest", sql="SELECT run_tag, count(*) AS rows, 'ok' AS status FROM preds GROUP BY 1")
def latency_timeseries_manifest(spark, sf):
    return latency.export_latency_timeseries(views.preds(spark, sf), new_path(spark, "series")).drop("latency_timeseries_path")


_DIST = """count(*) AS latency_rows, avg(end_to_end_ms) AS latency_avg_ms, min(end_to_end_ms) AS latency_min_ms, max(end_to_end_ms) AS latency_max_ms,
  quantile_cont(end_to_end_ms, 0.9::DOUBLE) AS latency_q90_ms, quantile_cont(end_to_end_ms, 0.95::DOUBLE) AS latency_q95_ms, quantile_cont(end_to_end_ms, 0.99::DOUBLE) AS latency_q99_ms"""
_DIST_FLOATS = "latency_avg_ms latency_min_ms latency_max_ms latency_q90_ms latency_q95_ms latency_q99_ms"


@query("latency_distribution", sql=f"""
SELECT mode, target_rps, {_DIST} FROM preds JOIN base_runs USING (run_tag) WHERE lower(coalesce(benchmark_phase, 'measure')) = 'measure' GROUP BY 1, 2""", floats=_DIST_FLOATS)
def latency_distribution(spark, sf):
    return latency.latency_distribution(views.preds(spark, sf), views.base_runs(spark, sf), ["mode", "target_rps"])


@query("latency_distribution_fault", sql=f"""
SELECT scenario, target_rps, {_DIST} FROM preds JOIN base_runs USING (run_tag)
WHERE lower(coalesce(benchmark_phase, 'measure')) = CASE WHEN fault_kind = 'none' THEN 'cold_start' ELSE 'post_fault' END GROUP BY 1, 2""", floats=_DIST_FLOATS)
def latency_distribution_fault(spark, sf):
    return latency.latency_distribution(
        views.preds(spark, sf), views.base_runs(spark, sf), ["scenario", "target_rps"], phase_by_fault_kind=True
    )


_RANGE = ", ".join(f"{a}({c}) AS {n}_{a}_ms" for n, c in latency.LATENCIES.items() for a in ("min", "max"))
_SKETCHED = ", ".join(f"count({c}) AS {n}_n, true AS {n}_close" for n, c in latency.LATENCIES.items())


@query("sketched_latencies", sql=f"""
SELECT mode, target_rps, count(*) AS rows, {_RANGE}, {_SKETCHED} FROM preds JOIN base_runs USING (run_tag) WHERE emit_time IS NOT NULL GROUP BY 1, 2""")
def sketched_latencies(spark, sf):
    """Latencies pooled over repeats from stored sketches per second, and whether the ranks of all quantiles lie within the bound."""
    preds, runs = views.preds(spark, sf), views.base_runs(spark, sf)
    kept = stored(sketches.latency_sketches(preds), "latency_sketches")
    keys, quantiles = ["mode", "target_rps"], (0.5, 0.95, 0.99)
    report = stored(sketches.merged_latencies(kept.join(runs.select("run_tag", *keys), "run_tag"), keys, quantiles), "merged_latencies")
    rows = preds.where("emit_time is not null").join(runs.select("run_tag", *keys), "run_tag")
    out = report.select(*keys, "rows", *[c for c in report.columns if c.endswith(("_min_ms", "_max_ms", "_n"))])
    for name, column in latency.LATENCIES.items():
        errors = [sketches.observed_rank_error(rows, keys, column, report, f"{name}_q{int(q * 100)}_ms", q) for q in quantiles]
        worst = functools.reduce(DataFrame.union, errors).groupBy(*keys).agg((F.max("rank_error") <= 3 * sketches.rank_error()).alias(f"{name}_close"))
        out = out.join(worst, keys)
    return out


@query("pool_runs", sql="SELECT run_tag, end_to_end_ms, processing_ms FROM preds")
def pool_runs(spark, sf):
    rows = views.preds(spark, sf)
    parts = [rows.where("run_tag = 'run0'"), rows.where("run_tag <> 'run0'").drop("absent")]
    return latency.pool_runs(parts, ["run_tag", "end_to_end_ms", "processing_ms", "absent"])


@query("pool_stored_runs", sql="""
SELECT count(*) AS rows, count(DISTINCT run_tag) AS runs, sum(kafka_partition)::BIGINT AS partitions, max(end_to_end_ms) AS e2e_max_ms FROM preds
WHERE coalesce(lower(benchmark_phase), 'measure') NOT IN ('warmup', 'cold_start', 'post_fault')""")
def pool_stored_runs(spark, sf):
    """All runs of one stored table, one phase."""
    from flowlib.sources import tables

    path = new_path(spark, "run-artifacts")
    tables.write_run_artifacts(views.preds(spark, sf), path)
    pooled = tables.read_run_artifacts(spark, path, [f"run{i}" for i in range(5)], "measure")
    return pooled.agg(
        F.count("*").alias("rows"), F.count_distinct("run_tag").alias("runs"), F.sum("kafka_partition").alias("partitions"), F.max("end_to_end_ms").alias("e2e_max_ms")
    )


@query("latency_summary_approx", sql="""
SELECT run_tag, count(*) AS rows, true AS near FROM preds WHERE lower(coalesce(benchmark_phase, 'measure')) = 'measure' GROUP BY 1""")
def latency_summary_approx(spark, sf):
    """Sketched percentiles: every one is a value whose rank is off by one in ten thousand rows at most."""
    rows = views.preds(spark, sf)
    rows = rows.where(in_phase(rows, "measure"))
    found = latency.latency_summary(views.preds(spark, sf), accuracy=10_000)
    near = []
    for name, column in latency.LATENCIES.items():
        for q in (0.50, 0.95, 0.99):
            value = F.col(f"artifact_{name}_p{int(q * 100)}_ms")
            slack = F.count(column) / 10_000 + 1
            near.append((F.count_if(F.col(column) < value) <= q * F.count(column) + slack) & (F.count_if(F.col(column) <= value) >= q * F.count(column) - slack))
    every = functools.reduce(lambda a, b: a & b, near)
    return rows.join(found, "run_tag").groupBy("run_tag").agg(F.count("*").alias("rows"), every.alias("near"))


@query("first_emit_delay", sql="""
SELECT run_tag, greatest((epoch_us(f) // 1000 - since) / 1000.0::DOUBLE, 0) AS first_emit_delay_sec FROM (SELECT run_tag, 1704067200000 + repeat_index * 60000 AS since FROM base_runs)
LEFT JOIN (SELECT run_tag, min(emit_time) AS f FROM preds WHERE benchmark_phase = 'post_fault' GROUP BY 1) USING (run_tag)
""".replace("greatest((epoch_us(f) // 1000 - since) / 1000.0::DOUBLE, 0)", "CASE WHEN f IS NOT NULL THEN greatest((epoch_us(f) // 1000 - since) / 1000.0::DOUBLE, 0) END"))
def first_emit_delay(spark, sf):
    starts = views.base_runs(spark, sf).selectExpr("run_tag", "1704067200000 + repeat_index * 60000 as since_epoch_ms")
    return latency.first_emit_delay(views.preds(spark, sf), starts, "post_fault")


FAULT_SQL = """
SELECT run_tag, n / CASE WHEN span > 0 THEN span END AS phase_output_rps, p AS phase_e2e_p95_ms FROM (
  SELECT run_tag, count(end_to_end_ms) AS n, (epoch_us(max(emit_time)) - epoch_us(min(emit_time))) / 1e6::DOUBLE AS span, quantile_cont(end_to_end_ms, 0.95::DOUBLE) AS p
  FROM preds JOIN base_runs USING (run_tag) WHERE lower(coalesce(benchmark_phase, 'measure')) = CASE WHEN fault_kind = 'none' THEN 'cold_start' ELSE 'post_fault' END GROUP BY 1)"""


@query("fault_phase_summary", sql=FAULT_SQL, floats="phase_output_rps phase_e2e_p95_ms")
def fault_phase_summary(spark, sf):
    return latency.fault_phase_summary(views.preds(spark, sf), views.base_runs(spark, sf))


@query("join_phase_summary", sql=f"SELECT run_tag, mode, scenario, phase_output_rps, phase_e2e_p95_ms FROM base_runs LEFT JOIN ({FAULT_SQL}) AS f USING (run_tag)", floats="phase_output_rps phase_e2e_p95_ms")
def join_phase_summary(spark, sf):
    from flowlib.operators.summary import join_phase_summary as join

    runs = views.base_runs(spark, sf)
    phases = latency.fault_phase_summary(views.preds(spark, sf), runs)
    return join(runs.select("run_tag", "mode", "scenario"), phases)


def _hour_series(spark, sf):
    """Latency per run and hour, shaped as the per-second series."""
    rows = views.preds(spark, sf).groupBy("run_tag", F.coalesce("benchmark_phase", F.lit("measure")).alias("benchmark_phase"), F.expr("unix_seconds(emit_time) div 3600").alias("second"))
    return rows.agg(F.max("end_to_end_ms").alias("e2e_p95_ms"), F.count("*").alias("rows"))


_HOURS = "SELECT run_tag, coalesce(benchmark_phase, 'measure') AS benchmark_phase, epoch_us(emit_time) // 3600000000 AS second, max(end_to_end_ms) AS e2e_p95_ms FROM preds GROUP BY 1, 2, 3"
_REBASED = f"SELECT run_tag, second - min(second) OVER (PARTITION BY run_tag) AS second, e2e_p95_ms AS value FROM ({_HOURS}) AS h WHERE lower(benchmark_phase) LIKE '%measure%'"


@query("rebase_series", sql=_REBASED)
def rebase_series(spark, sf):
    return latency.rebase_latency_series(_hour_series(spark, sf), "e2e_p95_ms")


@query("rebase_lag_series", sql="""
SELECT run_tag, (ts_epoch_ms - min(ts_epoch_ms) OVER (PARTITION BY run_tag)) // 1000 AS second, lag_records::DOUBLE AS value FROM lag_samples WHERE lower(phase) LIKE 'measure%'""")
def rebase_lag_series(spark, sf):
    return lag.rebase_lag_series(views.lag_samples(spark, sf))


@query("mean_series_by_second", sql=f"SELECT second, avg(value) AS value FROM ({_REBASED}) AS r GROUP BY 1", floats="value")
def mean_series_by_second(spark, sf):
    return latency.mean_series_by_second(latency.rebase_latency_series(_hour_series(spark, sf), "e2e_p95_ms"))


@query("empirical_cdf", sql="""
SELECT label, end_to_end_ms AS value, row_number() OVER (PARTITION BY label ORDER BY end_to_end_ms, event_id) / count(*) OVER (PARTITION BY label) AS cdf
FROM (SELECT 'RF-17 '||event_id % 3||' rps' AS label, end_to_end_ms, event_id FROM preds)""")
def empirical_cdf(spark, sf):
    rows = views.preds(spark, sf).withColumn("run_tag", F.expr("concat('modelfeaturetradeoff_rf17_', event_id % 3, 'rps_', run_tag)"))
    rows = rows.withColumn("run_tag", F.replace("run_tag", F.lit("_rf17_"), F.lit("_x_rf17_")))
    return latency.empirical_cdf(latency.with_short_label(rows.drop("label")), ["label"], "end_to_end_ms", "event_id")


@query("empirical_cdf_per_run", sql="""
SELECT run_tag, processing_ms AS value, row_number() OVER (PARTITION BY run_tag ORDER BY processing_ms, event_id) / count(*) OVER (PARTITION BY run_tag) AS cdf FROM preds""")
def empirical_cdf_per_run(spark, sf):
    return latency.empirical_cdf(views.preds(spark, sf), ["run_tag"], "processing_ms", "event_id")


@query("nearest_rank_percentiles", sql="""
SELECT lang, max(n_chars) FILTER (rn = round_even((c - 1) * 0.5::DOUBLE, 0) + 1)::DOUBLE AS p50, max(n_chars) FILTER (rn = round_even((c - 1) * 0.95::DOUBLE, 0) + 1)::DOUBLE AS p95
FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY lang) AS c FROM documents) GROUP BY 1""")
def nearest_rank_percentiles(spark, sf):
    rows = views.table(spark, sf, "documents")
    return exact_percentiles(rows, ["lang"], {"p50": ("n_chars", 0.5), "p95": ("n_chars", 0.95)}, method="nearest")


@query("max_offset_per_partition", sql="""
SELECT kafka_partition, max(kafka_offset) AS max_offset FROM preds WHERE lower(coalesce(benchmark_phase, 'measure')) = 'measure' GROUP BY 1""")
def max_offset_per_partition(spark, sf):
    return lag.max_offset_per_partition(views.preds(spark, sf, offsets=True))


def _watermarks(spark, sf):
    """Offsets of every input partition, and one partition without predictions."""
    ends = views.flows(spark, sf).groupBy(F.col("kafka_partition").alias("topic_partition")).agg(F.count("*").alias("n"))
    known = ends.selectExpr("topic_partition", "cast(0 as bigint) as low", "n + topic_partition as high")
    return known.unionByName(ends.where("topic_partition = 0").selectExpr("4 as topic_partition", "cast(5 as bigint) as low", "n as high"))


_MARKS = """WITH w AS (SELECT kafka_partition AS topic_partition, 0 AS low, count(*) + kafka_partition AS high FROM flows GROUP BY kafka_partition
  UNION ALL SELECT 4, 5, count(*) FROM flows WHERE kafka_partition = 0)"""


@query("offset_lag", sql=f"""{_MARKS}, m AS (SELECT kafka_partition, max(kafka_offset) AS o FROM preds WHERE lower(coalesce(benchmark_phase, 'measure')) = 'measure' GROUP BY 1)
SELECT 'ok' AS kafka_lag_status, greatest(sum(greatest(high - 1 - o, 0))::BIGINT - 1, 0) AS kafka_lag_records_end, sum(greatest(high - 1 - o, 0))::BIGINT AS kafka_lag_records_raw_end,
  1 AS kafka_control_tail_records, count(*) AS kafka_lag_partitions, max(high)::BIGINT AS kafka_high_watermark_max FROM m JOIN w ON kafka_partition = topic_partition""")
def offset_lag(spark, sf):
    return lag.offset_lag(views.preds(spark, sf, offsets=True), _watermarks(spark, sf), control_tail_records=1)


@query("sampler_lag", sql=f"""{_MARKS}, m AS (SELECT kafka_partition, max(kafka_offset) AS o FROM preds GROUP BY 1)
SELECT sum(greatest(high - (coalesce(o, low - 1) + 1), 0))::BIGINT AS raw_lag_records, max(high)::BIGINT AS high_watermark_max, max(coalesce(o, low - 1))::BIGINT AS processed_offset_max,
  count(*) AS partition_count, greatest(sum(greatest(high - (coalesce(o, low - 1) + 1), 0))::BIGINT - 2, 0) AS lag_records, 'ok' AS status FROM w LEFT JOIN m ON kafka_partition = topic_partition""")
def sampler_lag(spark, sf):
    return lag.sampler_lag(views.preds(spark, sf, offsets=True), _watermarks(spark, sf), control_tail_records=2)


def per_run(spark, sf):
    """Predictions whose offset is the event, and the watermarks of every run's own topic: its last offset of any phase."""
    rows = views.preds(spark, sf).withColumn("kafka_offset", F.col("event_id"))
    marks = rows.groupBy("run_tag", F.col("kafka_partition").alias("topic_partition")).agg(
        F.min("kafka_offset").alias("low"), (F.max("kafka_offset") + 1).alias("high")
    )
    return rows, marks


# Lag at the end of the measured phase over each run's own topic; every run has predictions of that phase.
RUN_LAG_SQL = """
SELECT run_tag, 'ok' AS kafka_lag_status, raw AS kafka_lag_records_end, raw AS kafka_lag_records_raw_end, 0 AS kafka_control_tail_records, n AS kafka_lag_partitions, top AS kafka_high_watermark_max
FROM (SELECT run_tag, (sum(high - 1 - o) FILTER (o IS NOT NULL))::BIGINT AS raw, count(o) AS n, (max(high) FILTER (o IS NOT NULL))::BIGINT AS top
  FROM (SELECT run_tag, kafka_partition, max(event_id) + 1 AS high, max(event_id) FILTER (lower(coalesce(benchmark_phase, 'measure')) = 'measure') AS o FROM preds GROUP BY 1, 2) GROUP BY 1)"""


@query("offset_lag_by_run", sql=RUN_LAG_SQL)
def offset_lag_by_run(spark, sf):
    return lag.offset_lag(*per_run(spark, sf), keys=["run_tag"])


@query("sampler_lag_by_run", sql="""
SELECT run_tag, sum(CASE WHEN o IS NULL THEN high - low ELSE high - 1 - o END)::BIGINT AS raw_lag_records, max(high)::BIGINT AS high_watermark_max, max(coalesce(o, low - 1))::BIGINT AS processed_offset_max,
  count(*) AS partition_count, greatest(sum(CASE WHEN o IS NULL THEN high - low ELSE high - 1 - o END)::BIGINT - 1, 0) AS lag_records, 'ok' AS status
FROM (SELECT run_tag, kafka_partition, min(event_id) AS low, max(event_id) + 1 AS high, max(event_id) FILTER (event_id % 20 > 10) AS o FROM preds GROUP BY 1, 2) GROUP BY 1""")
def sampler_lag_by_run(spark, sf):
    """Part of the records processed; a run whose records are all unprocessed counts from its low watermark."""
    rows, marks = per_run(spark, sf)
    return lag.sampler_lag(rows.where("event_id % 20 > 10"), marks, 1, ["run_tag"])


_GOOD = "phase LIKE 'measure%' AND status = 'ok'"
LAG_SQL = f"""
SELECT run_tag, count(*) AS kafka_lag_samples, max(lag_records) FILTER ({_GOOD}) AS kafka_lag_peak_records,
  first(phase ORDER BY lag_records DESC, ts_epoch_ms) FILTER ({_GOOD}) AS kafka_lag_peak_phase,
  first(lag_records ORDER BY ts_epoch_ms) FILTER (event = 'measure_replay_end') AS kafka_lag_at_replay_end_records,
  last(lag_records ORDER BY ts_epoch_ms) FILTER ({_GOOD}) AS kafka_lag_end_after_drain_records FROM lag_samples GROUP BY 1"""
CLEAR_SQL = f"""
SELECT run_tag, CASE WHEN el <= 0 THEN 0 ELSE (min(ts_epoch_ms) FILTER ({_GOOD} AND ts_epoch_ms >= et AND lag_records <= 0) - et) / 1000.0::DOUBLE END AS kafka_lag_clear_sec
FROM lag_samples JOIN (SELECT run_tag, ts_epoch_ms AS et, lag_records AS el FROM lag_samples WHERE event = 'measure_replay_end') USING (run_tag) GROUP BY run_tag, et, el"""
AREA_SQL = f"""
SELECT run_tag, sum((ts_epoch_ms - p) / 1000.0::DOUBLE * l) AS kafka_lag_area_records_sec FROM (SELECT run_tag, ts_epoch_ms, lag(ts_epoch_ms) OVER w AS p, lag(lag_records) OVER w AS l
  FROM lag_samples WHERE {_GOOD} WINDOW w AS (PARTITION BY run_tag ORDER BY ts_epoch_ms)) GROUP BY 1"""


@query("lag_summary", sql=LAG_SQL)
def lag_summary(spark, sf):
    return lag.lag_summary(views.lag_samples(spark, sf))


@query("lag_clear_seconds", sql=CLEAR_SQL)
def lag_clear_seconds(spark, sf):
    return lag.lag_clear_seconds(views.lag_samples(spark, sf))


@query("lag_area", sql=AREA_SQL, floats="kafka_lag_area_records_sec")
def lag_area(spark, sf):
    return lag.lag_area(views.lag_samples(spark, sf))
